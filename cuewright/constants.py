"""Word lists, patterns and thresholds that results depend on.

Every list is a default of some operator's parameter and can be replaced by the caller.
"""

# Accented Portuguese letters and their plain forms, position by position (fixed values).
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"

# Letters kept by the accent-preserving normaliser (fixed values).
KEPT_LETTERS = "0-9a-záàâãéêíóôõúüç%"

# Hesitation patterns (fixed values).
FILLER_PATTERN = r"^(eh+|éh+|ah+n*|ahn|ãh*|hu+m+|hm+|umm+|uh+|ahm|e{2,}h*|é{2,}|a{2,}h*)$"
LONG_VOWEL_PATTERN = r"^(e|é|a|ã|um|hum)$"
FILLER_TRIM = ".,!?…;:\"'"

# Vowels counted as syllable cores (fixed values).
VOWELS = "aeiouáéíóúâêôãõà"

# Keywords spoken off the record in a recording session (fixed values).
BACKSTAGE_PATTERN = (
    r"\bpaus|\bcorta\b|\bcorte\b|\bcortar\b|tira (isso|essa|esse)|\bexclu|\bapaga|esquece isso|"
    r"fora do ar|não (grava|publica|posta|coloca|põe|bota)|deixa quiet|\boff\b|desliga|tá gravando|"
    r"recomeç|regrav|refaz|de novo|faz aí|vou reformular|reformula|pode ir|pode continuar|"
    r"um, dois, três|\b1, 2, 3\b|no (número )?3|peraí|espera aí|calma aí|segura aí|"
    r"aí tu (fala|começa|entra)|tu fala assim|contextualiza|enquadramento|tá saindo|"
    r"reavalia|bloco|bate.?bola|esse corte|ficou bom"
)

# File kinds by extension (fixed values).
FONT_EXT = ("ttf", "otf", "woff", "woff2")
AUDIO_FX_EXT = ("wav", "mp3", "aif", "aiff", "m4a")
AUDIO_EXT = ("wav", "mp3", "aif", "aiff", "m4a", "flac", "ogg")
LOGO_EXT = ("png", "svg", "pdf", "ai")
VIDEO_EXT = ("mp4", "mov", "mkv", "webm")
IMAGE_EXT = ("png", "jpg", "jpeg", "webp", "svg")
LUT_EXT = ("cube", "3dl")
LAYOUT_VIDEO_EXT = ("mp4", "mov", "mkv", "mxf", "avi", "webm", "mts", "m2ts")
SFX_PATTERN = r"click|clique|whoosh|swoosh|pop|efx|sfx|riser|hit|impact|transi"
OVERLAY_PATTERN = r"overlay|light|leak|grain|card|seguir|instagram"

# Path hints of the project layout audit (fixed values).
RAW_HINT = r"(?i)(^|[_ -])(master|raw|bruto|gravacao|gravação|proxy|camera|cam\d|obs)([_ .-]|$)"
STOCK_HINT = r"(?i)(stock|pexels|pixabay|coverr|videvo|broll|b-roll)"
VFX_HINT = (
    r"(?i)(vfx|fsx|overlay|transition|transicao|transição|film.?burn|light.?leak|glitch|particle)"
)
UNSTABLE_HINT = r"(?i)(final[_ -]?final|teste\d*|novo\d*)"
LAYOUT_REQUIRED = (
    "01_sources", "02_transcripts", "03_assets", "04_work", "05_qa", "06_deliverables",
    "07_manifests",
)
LAYOUT_SUBDIRS = (
    "01_sources/masters", "01_sources/audio", "01_sources/proxies", "03_assets/brand",
    "03_assets/fonts", "03_assets/music", "03_assets/sfx", "03_assets/vfx_overlays",
    "03_assets/stock_local_only", "03_assets/licenses",
)
SKIPPED_FILES = (".DS_Store", "Thumbs.db")
