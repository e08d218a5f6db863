"""Text expressions. All of them are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def norm_keep(c: Column | str) -> Column:
    """Lower-case tokens; accents and percent signs stay, anything else becomes a break."""
    lowered = F.replace(F.lower(_col(c)), F.lit("’"), F.lit("'"))
    return tokens(F.regexp_replace(lowered, f"[^{K.KEPT_LETTERS} ]", " "))


def norm_token(c: Column | str) -> Column:
    """Single-token form of the accent-preserving normaliser (hyphens stay)."""
    return F.regexp_replace(F.lower(_col(c)), rf"[^{K.KEPT_LETTERS}\-]", "")


def fold_accents(c: Column | str) -> Column:
    return F.translate(F.lower(_col(c)), K.ACCENTED, K.PLAIN)


def norm_strip(c: Column | str) -> Column:
    """Accent-free alphanumeric form, percent kept."""
    return F.regexp_replace(fold_accents(c), "[^a-z0-9%]", "")


def norm_key(c: Column | str) -> Column:
    """Letters and digits only, accents kept."""
    return F.regexp_replace(F.lower(_col(c)), "[^0-9a-zà-ÿ]", "")


def trim_punct(c: Column | str, marks: str = ".,;:!?") -> Column:
    return F.btrim(F.lower(_col(c)), F.lit(marks))


def slug(c: Column | str, sep: str = "-", limit: int = 60) -> Column:
    """Lower-case ascii slug. Letters outside the fold table are dropped like punctuation."""
    ascii_only = F.regexp_replace(fold_accents(c), r"[^\x00-\x7f]", "")
    joined = F.regexp_replace(ascii_only, "[^a-z0-9]+", sep)
    cut = F.substring(F.btrim(joined, F.lit(sep)), 1, limit)
    return F.when(cut == "", F.lit("item")).otherwise(cut)


def apply_fixes(c: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Ordered case-insensitive regex replacements in one expression."""
    return reduce(lambda acc, p: F.regexp_replace(acc, "(?iu)" + p[0], p[1]), pairs, _col(c))


def clean_text(c: Column | str) -> Column:
    """Without tags, with single spaces and no space before punctuation."""
    no_tags = F.regexp_replace(_col(c), "<[^>]+>", "")
    spaced = F.btrim(F.regexp_replace(no_tags, r"\s+", " "))
    return F.regexp_replace(spaced, r"\s+([,.?!])", "$1")


def cut_words(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, never in the middle of a word, with an ellipsis."""
    flat = F.btrim(F.regexp_replace(_col(c), r"\s+", " "))
    head = F.regexp_replace(F.substring(flat, 1, n), r" [^ ]*$", "")
    return F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(F.regexp_replace(head, "[,.;:—-]+$", ""), F.lit("…"))
    )


def flag_words(words: Column | str, emphasis: Sequence[str]) -> Column:
    """One flag per token: is its normal form in the emphasis list."""
    wanted = F.array(*[F.lit(w) for w in emphasis])
    return F.transform(_col(words), lambda w: F.array_contains(wanted, norm_token(w)))


def single_emphasis(words: Column | str, flags: Column | str) -> Column:
    """Keep the strongest flagged word: one with a digit first, then the longest, then the first."""
    w, f = _col(words), _col(flags)
    ranked = F.transform(
        w,
        lambda x, i: F.when(
            F.get(f, i),
            F.struct(x.rlike("[0-9]").alias("d"), F.length(x).alias("n"), (-i).alias("i")),
        ),
    )
    best = F.array_max(ranked)
    return F.when(
        F.size(F.filter(f, lambda x: x)) > 1, F.transform(w, lambda _, i: i == -best["i"])
    ).otherwise(f)


def solid_length(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(c), r"\s+", ""))


def cps(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Non-space characters per second."""
    return solid_length(text) / F.greatest(_col(end) - _col(start), F.lit(0.001))


def syllables(c: Column | str) -> Column:
    return F.greatest(
        F.lit(1), F.size(F.regexp_extract_all(norm_key(c), F.lit(f"[{K.VOWELS}]+"), F.lit(0)))
    )


def style_like(caption: Column | str, heard: Column | str, marks: str = ".,?!…;:") -> Column:
    """Caption word in the casing and closing punctuation of the heard word; acronyms stay."""
    core = F.btrim(_col(caption), F.lit(marks))
    heard_core = F.btrim(_col(heard), F.lit(marks))
    bare = F.rtrim(_col(heard), F.lit(marks))
    tail = F.substring(_col(heard), F.length(bare) + 1, F.length(_col(heard)))
    acronym = (F.upper(core) == core) & (F.lower(core) != core) & (F.length(core) >= 2)
    first_heard = F.substring(heard_core, 1, 1)
    upper_first = (F.upper(first_heard) == first_heard) & (F.lower(first_heard) != first_heard)
    first = F.substring(core, 1, 1)
    rest = F.substring(core, F.lit(2), F.length(core))
    styled = (
        F.when(acronym, core)
        .when(upper_first, F.concat(F.upper(first), rest))
        .otherwise(F.concat(F.lower(first), rest))
    )
    return F.concat(styled, tail)


def filler_key(c: Column | str) -> Column:
    return F.btrim(F.lower(_col(c)), F.lit(K.FILLER_TRIM))


def is_filler(c: Column | str) -> Column:
    return filler_key(c).rlike(K.FILLER_PATTERN)


def is_long_vowel(c: Column | str, seconds: Column, over: float = 0.45) -> Column:
    return filler_key(c).rlike(K.LONG_VOWEL_PATTERN) & (seconds > over)


def tag_cost(tags: Column | str) -> Column:
    """Joined length plus two for each tag that holds a space."""
    t = _col(tags)
    return F.length(F.array_join(t, ",")) + 2 * F.size(F.filter(t, lambda x: x.contains(" ")))


def is_hallucination(c: Column | str, over: int = 12, distinct: int = 3) -> Column:
    """Many tokens from almost no vocabulary."""
    t = tokens(c)
    return (F.size(t) > over) & (F.size(F.array_distinct(t)) <= distinct)


def slice_words(words: Column | str, f0: Column, f1: Column, whole: float = 0.85) -> Column:
    """The share of the words spoken between two time fractions, all of them when it is most."""
    w = _col(words)
    n = F.size(w)
    first = F.floor(n * f0).cast("int")
    last = F.rint(n * f1).cast("int")
    return F.when(f1 - f0 >= whole, w).otherwise(
        F.when(last > first, F.slice(w, first + 1, F.greatest(last - first, F.lit(1))))
        .otherwise(F.array().cast("array<string>"))
    )


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 when both sides are empty."""
    left, right = _col(a), _col(b)
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def contains_any(c: Column | str, needles: Sequence[str]) -> Column:
    """Which of a fixed list of needles occur in the text."""
    text = _col(c)
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: text.contains(n))


def first_keyword(c: Column | str, rules: Sequence[tuple[str, str]], fallback: int = 38) -> Column:
    """Title of the first rule whose keyword the text holds, else the shortened text."""
    text = _col(c)
    titles = [F.when(text.contains(key), F.lit(title)) for key, title in rules]
    return F.coalesce(*titles, cut_words(text, fallback))


def match_alias(c: Column | str, registry: Mapping[str, Sequence[str]]) -> Column:
    """Clients with at least one alias inside the lower-case text, in registry order."""
    low = F.lower(_col(c))
    hits = []
    for client, aliases in registry.items():
        found = reduce(lambda a, b: a | b, [low.contains(a) for a in aliases])
        hits.append(F.when(found, F.lit(client)))
    return F.array_compact(F.array(*hits))


def guess_client(c: Column | str, registry: Mapping[str, Sequence[str]]) -> Column:
    """First client whose name or alias slug (longer than three letters) is in the slug of the
    whole path, else ``_global``."""
    low = F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "-")
    rules = []
    for client, aliases in registry.items():
        for alias in (client, *aliases):
            needle = slug(F.lit(alias))
            rules.append(F.when((F.length(needle) > 3) & F.contains(low, needle), F.lit(client)))
    return F.coalesce(*rules, F.lit("_global"))


def sentence_tags(c: Column | str) -> Column:
    """Sentences of a text as a tag list."""
    parts = F.transform(
        F.split(_col(c), r"\."), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    )
    return F.filter(parts, lambda x: x != "")
