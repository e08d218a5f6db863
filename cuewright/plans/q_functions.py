"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions import paths, signal, text, time
from cuewright.operators import words
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.registry import query

EMPHASIS = ("porto", "navio", "que", "the", "de", "tion")
FIXES = (("ção", "cao"), ("th[aeiou]", "TH"), ("ou+", "u"))
WORD_FIXES = {"the": "a", "que": "qué", "de": "di", "and": "&"}
EXTENSIONS = ("txt", "wav", "mp4", "png", "ttf", "flac", "cube", "mov", "ai", "onnx")
STEMS = ("doc", "whoosh hit", "film burn", "logo", "master_cam1", "stock clip", "light leak", "teste2")
TITLES = (("the ", "English clip"), ("que ", "Romance clip"), ("der ", "German clip"))


def _list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_KEEP = "[^" + K.KEPT_LETTERS + " ]"
_TOKEN = "[^" + K.KEPT_LETTERS + "\\-]"
_TOKENS = "list_filter(string_split_regex({0},'\\s+'), lambda x: x<>'')"
_FOLD = f"translate(lower({{0}}),'{K.ACCENTED}','{K.PLAIN}')"
_VOCAB = "select distinct word from word"


def _vocab(spark, d):
    return B.word(spark, d).select("word").distinct()


@query("fn1_norm_keep", f"""select doc_id, array_to_string({_TOKENS.format(
    f"regexp_replace(replace(lower(text),'’',''''),'{_KEEP}',' ','g')")},' ') as norm from documents""")
def fn1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.norm_keep("text"), " ").alias("norm"))


@query("fn2_norm_strip", with_("word", f"""select word, regexp_replace({_FOLD.format('word')},'[^a-z0-9%]','','g') as norm
    from ({_VOCAB})"""))
def fn2(spark, d):
    return _vocab(spark, d).select("word", text.norm_strip("word").alias("norm"))


@query("fn3_norm_key", with_("word", f"select word, regexp_replace(lower(word),'[^0-9a-zà-ÿ]','','g') as norm from ({_VOCAB})"))
def fn3(spark, d):
    return _vocab(spark, d).select("word", text.norm_key("word").alias("norm"))


@query("fn4_trim_punct", with_("word", f"select word, trim(lower(word),'.,;:!?') as norm from ({_VOCAB})"))
def fn4(spark, d):
    return _vocab(spark, d).select("word", text.trim_punct("word").alias("norm"))


def _slug_sql(c: str, sep: str) -> str:
    body = f"regexp_replace(regexp_replace({_FOLD.format(c)},'[^\\x00-\\x7f]','','g'),'[^a-z0-9]+','{sep}','g')"
    return f"coalesce(nullif(substr(trim({body},'{sep}'),1,60),''),'item')"


@query("fn5_slug", f"select page_id, {_slug_sql('url','-')} as dashed, {_slug_sql('html','_')} as scored from pages")
def fn5(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.slug("url").alias("dashed"), text.slug("html", "_").alias("scored")
    )


_CODE = "turn || ':' || (conv_id % 60) || ':' || (length(text) % 60) || ',' || lpad(cast(length(text) % 1000 as varchar),3,'0')"


@query("fn6_to_seconds", """select conv_id, turn, (turn*60.0::double + conv_id%60)*60 + cast((length(text)%60) || '.' ||
    lpad(cast(length(text)%1000 as varchar),3,'0') as double) as clock, turn*60.0::double + conv_id%60 as short,
    ((turn*60.0::double + conv_id%60)*60 + length(text)%60) + (length(text)%30)/30.0::double as framed from conversations""")
def fn6(spark, d):
    n = F.length("text")
    c = table(spark, d, "conversations")
    clock = F.concat("turn", F.lit(":"), F.col("conv_id") % 60, F.lit(":"), n % 60, F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    short = F.concat("turn", F.lit(":"), F.col("conv_id") % 60)
    framed = F.concat("turn", F.lit(":"), F.col("conv_id") % 60, F.lit(":"), n % 60, F.lit(":"), n % 30)
    return c.select(
        "conv_id", "turn",
        time.to_seconds(clock).alias("clock"), time.to_seconds(short).alias("short"),
        time.to_seconds(framed, fps=30).alias("framed"),
    )


@query("fn7_fmt_seconds", with_("interval", """, t as (select event_id, e, cast(floor(e) as bigint) as w,
      cast(round(e*1000) as bigint) as ms, cast(round(e*10) as bigint) as d from "interval" where event_type_ok)
    select event_id, printf('%02d:%02d:%02d', w//3600, w%3600//60, w%60) as hms,
      printf('%02d:%02d:%02d,%03d', ms//3600000, ms%3600000//60000, ms%60000//1000, ms%1000) as srt,
      printf('%d:%02d:%02d.%d', d//36000, d%36000//600, d%600//10, d%10) as tenth,
      printf('%02d:%02d:%02d:%02d', w//3600, w%3600//60, w%60, cast(round((e-w)*30) as bigint)) as framed from t
    """).replace(" where event_type_ok", ""))
def fn7(spark, d):
    return B.interval(spark, d).select(
        "event_id",
        time.fmt_seconds("e", "hms").alias("hms"), time.fmt_seconds("e", "srt").alias("srt"),
        time.fmt_seconds("e", "tenth").alias("tenth"), time.fmt_seconds("e", "frames").alias("framed"),
    )


@query("fn8_fps_ratio", """select p_partkey, case when p_partkey%3=0 then 0.0::double
    else (p_size*1000)/(p_partkey%3*1001.0::double) end as fps from part""")
def fn8(spark, d):
    ratio = F.concat(F.col("p_size") * 1000, F.lit("/"), F.col("p_partkey") % 3 * 1001)
    return table(spark, d, "part").select("p_partkey", time.fps_ratio(ratio).alias("fps"))


@query("fn9_apply_fixes", """select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,'ção','cao','gi'),
    'th[aeiou]','TH','gi'),'ou+','u','gi')) as fixed from documents""")
def fn9(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.apply_fixes("text", FIXES)).alias("fixed"))


@query("fn10_fix_words", with_("word", """select media_id, case word when 'the' then 'a' when 'que' then 'qué'
    when 'de' then 'di' when 'and' then '&' else word end as fixed, count(*) as n from word group by 1,2"""))
def fn10(spark, d):
    fixed = words.fix_words("word", WORD_FIXES).alias("fixed")
    return B.word(spark, d).groupBy("media_id", fixed).agg(F.count("*").alias("n"))


@query("fn11_clean_text", r"""select page_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),
    '\s+',' ','g')),'\s+([,.?!])','\1','g')) as clean from pages""")
def fn11(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.clean_text("html")).alias("clean"))


@query("fn12_cut_words", r"""select doc_id, case when length(f)<=38 then f else
    regexp_replace(regexp_replace(substr(f,1,38),' [^ ]*$',''),'[,.;:—-]+$','') || '…' end as title
    from (select doc_id, trim(regexp_replace(text,'\s+',' ','g')) as f from documents)""")
def fn12(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cut_words("text", 38).alias("title"))


@query("fn13_fmt_br", "select o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') as number from orders")
def fn13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", time.fmt_br("o_totalprice", 2).alias("number"))


@query("fn14_parse_export_date", """select event_id, cast(ts as date) as month_first,
    make_date(1996, month(ts), day(ts)) as day_month, date_trunc('minute', ts) + interval 4 hour as shifted from events""")
def fn14(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        time.parse_export_date(F.date_format("ts", "MMM d, yyyy"), "month_first").alias("month_first"),
        time.parse_export_date(F.date_format("ts", "d MMMM"), "day_month", year=1996).alias("day_month"),
        time.parse_export_date(F.date_format("ts", "MM/dd/yyyy HH:mm"), "shifted").alias("shifted"),
    )


@query("fn15_first_keyword", r"""select doc_id, case when contains(text,'the ') then 'English clip'
    when contains(text,'que ') then 'Romance clip' when contains(text,'der ') then 'German clip'
    when length(f)<=38 then f else regexp_replace(regexp_replace(substr(f,1,38),' [^ ]*$',''),'[,.;:—-]+$','') || '…' end as title
    from (select doc_id, text, trim(regexp_replace(text,'\s+',' ','g')) as f from documents)""")
def fn15(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_keyword("text", TITLES).alias("title"))


_FLAGGED = f"list_filter({_TOKENS.format('text')}, lambda x: list_contains({_list(EMPHASIS)}, regexp_replace(lower(x),'{_TOKEN}','','g')))"


@query("fn16_flag_words", f"""select conv_id, turn, array_to_string({_FLAGGED},' ') as emph, len({_FLAGGED})>0 as any_emph
    from conversations""")
def fn16(spark, d):
    w = text.tokens("text")
    caps = table(spark, d, "conversations").select("conv_id", "turn", w.alias("w"))
    caps = caps.withColumn("em", text.flag_words("w", EMPHASIS))
    return caps.select(
        "conv_id", "turn",
        F.array_join(F.filter("w", lambda x, i: F.get("em", i)), " ").alias("emph"),
        F.exists("em", lambda x: x).alias("any_emph"),
    )


@query("fn17_single_emphasis", f"""select conv_id, turn, len(f)>0 as any_emph,
    (select first(x order by regexp_matches(x,'[0-9]') desc, length(x) desc, i) from
      (select unnest(f) as x, generate_subscripts(f,1) as i)) as emph
    from (select conv_id, turn, {_FLAGGED} as f from conversations)""")
def fn17(spark, d):
    caps = table(spark, d, "conversations").select("conv_id", "turn", text.tokens("text").alias("w"))
    caps = caps.withColumn("em", text.flag_words("w", EMPHASIS))
    caps = caps.withColumn("em", text.single_emphasis("w", "em"))
    kept = F.filter("w", lambda x, i: F.get("em", i))
    return caps.select(
        "conv_id", "turn", F.exists("em", lambda x: x).alias("any_emph"),
        F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("emph"),
    )


@query("fn18_cps", with_("caption", r"""select clip_id, seq, length(regexp_replace(text,'\s+','','g'))/greatest(e-s,0.001::double) as cps
    from caption"""))
def fn18(spark, d):
    return B.caption(spark, d).select("clip_id", "seq", text.cps("text", F.col("s"), F.col("e")).alias("cps"))


@query("fn19_syllables", with_("word", f"""select word, greatest(1, len(regexp_extract_all(
    regexp_replace(lower(word),'[^0-9a-zà-ÿ]','','g'),'[{K.VOWELS}]+'))) as syllables from ({_VOCAB})"""))
def fn19(spark, d):
    return _vocab(spark, d).select("word", text.syllables("word").alias("syllables"))


@query("fn20_style_like", """select p_partkey, case when p_size%3=0 then upper(p_name)
    when p_size%2=0 then upper(substr(p_name,1,1))||substr(p_name,2) else p_name end ||
    case when p_size%5=0 then '.' else '' end as styled from part""")
def fn20(spark, d):
    size = F.col("p_size")
    cap = F.when(size % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    heard = F.concat(
        F.when(size % 2 == 0, F.initcap("p_type")).otherwise(F.lower("p_type")), F.when(size % 5 == 0, ".").otherwise("")
    )
    return table(spark, d, "part").select("p_partkey", text.style_like(cap, heard).alias("styled"))


@query("fn21_is_filler", with_("word", f"""select k as filler, regexp_matches(k,'{K.FILLER_PATTERN}') as is_filler,
      regexp_matches(k,'{K.LONG_VOWEL_PATTERN}') and e-s>0.09::double as is_vowel, count(*) as n
    from (select trim(lower(word),'.,!?…;:"''') as k, s, e from word)
    where regexp_matches(k,'{K.FILLER_PATTERN}') or regexp_matches(k,'{K.LONG_VOWEL_PATTERN}') group by 1,2,3"""))
def fn21(spark, d):
    filler = text.is_filler("word")
    vowel = text.is_long_vowel("word", F.col("e") - F.col("s"), over=0.09)
    return (
        B.word(spark, d)
        .filter(filler | text.filler_key("word").rlike(K.LONG_VOWEL_PATTERN))
        .groupBy(text.filler_key("word").alias("filler"), filler.alias("is_filler"), vowel.alias("is_vowel"))
        .agg(F.count("*").alias("n"))
    )


_TAGS = "list_filter(list_transform(string_split(text,'.'), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))), lambda x: x<>'')"


@query("fn22_tag_cost", f"""select doc_id, length(array_to_string(t,',')) + 2*len(list_filter(t, lambda x: contains(x,' '))) as cost
    from (select doc_id, {_TAGS} as t from documents)""")
def fn22(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tag_cost(text.sentence_tags("text")).alias("cost"))


_PATH = f"source || '/' || lang || '/' || {_list(STEMS)}[doc_id%8+1] || '_' || doc_id || '.' || {_list(EXTENSIONS)}[doc_id%10+1]"


def typed_paths(spark, d):
    """File paths whose stem and extension follow the document number."""
    stems = F.array(*[F.lit(x) for x in STEMS])
    exts = F.array(*[F.lit(x) for x in EXTENSIONS])
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(
            "source", F.lit("/"), "lang", F.lit("/"), F.get(stems, F.col("doc_id") % 8), F.lit("_"), "doc_id",
            F.lit("."), F.get(exts, F.col("doc_id") % 10),
        ).alias("path"),
    )


def _in(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


@query("fn23_guess_type", f"""select doc_id, case when x in {_in(K.FONT_EXT)} then 'fonte' when x='onnx' then 'modelo'
    when contains(p,'burn') then 'filmburn' when regexp_matches(p,'{K.SFX_PATTERN}') and x in {_in(K.AUDIO_FX_EXT)} then 'sfx'
    when x in {_in(K.AUDIO_EXT)} then 'musica' when contains(p,'logo') and x in {_in(K.LOGO_EXT)} then 'logo'
    when x in {_in(K.VIDEO_EXT)} and regexp_matches(p,'{K.OVERLAY_PATTERN}') then 'overlay'
    when x in {_in(K.VIDEO_EXT)} then 'video' when x in {_in(K.IMAGE_EXT)} then 'imagem'
    when x in {_in(K.LUT_EXT)} then 'lut' else 'outro' end as kind
    from (select doc_id, lower({_PATH}) as p, {_list(EXTENSIONS)}[doc_id%10+1] as x from documents)""")
def fn23(spark, d):
    return typed_paths(spark, d).select("doc_id", paths.guess_type("path").alias("kind"))


@query("fn24_classify_path", f"""select doc_id, case when regexp_matches(p,'{K.RAW_HINT}') then 'raw'
    when regexp_matches(p,'{K.STOCK_HINT}') then 'stock' when regexp_matches(p,'{K.VFX_HINT}') then 'vfx' else 'none' end as hint,
    regexp_matches(regexp_extract(p,'([^/]*)\\.[^.]*$',1),'{K.UNSTABLE_HINT}') as unstable, true as loose
    from (select doc_id, {_PATH} as p from documents)""")
def fn24(spark, d):
    return typed_paths(spark, d).select("doc_id", paths.classify_path("path").alias("c")).select("doc_id", "c.*")


@query("fn25_to_db", """select p_partkey, round(20*log10(sqrt(p_retailprice/100000)+1e-9::double),6) as db,
    round(pow(10.0::double,(p_size-60)/20.0::double),9) as gain from part""")
def fn25(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.round(signal.to_db(F.col("p_retailprice") / 100000), 6).alias("db"),
        F.round(signal.from_db(F.col("p_size") - 60), 9).alias("gain"),
    )


@query("fn26_skin_vector", """select p_partkey, round(degrees(atan2(v,u)),6) as angle, round(sqrt(u*u+v*v),6) as chroma from (
    select p_partkey, 0.492::double*(b-y) as u, 0.877::double*(r-y) as v from (
    select *, r*0.299::double+g*0.587::double+b*0.114::double as y from (
    select p_partkey, p_size/50.0::double as r, p_retailprice/2100 as g, (p_partkey%97)/97.0::double as b from part)))""")
def fn26(spark, d):
    v = signal.skin_vector(F.col("p_size") / 50.0, F.col("p_retailprice") / 2100, (F.col("p_partkey") % 97) / 97.0)
    return table(spark, d, "part").select("p_partkey", v.alias("v")).select(
        "p_partkey", F.round("v.angle", 6).alias("angle"), F.round("v.chroma", 6).alias("chroma")
    )


REGISTRY = {"english": ("/en/",), "german": ("/de/",), "latin": ("/fr/", "/es/")}


@query("fn27_match_alias", """select page_id, client from pages, (values ('english','/en/'),('german','/de/'),
    ('latin','/fr/'),('latin','/es/')) as r(client, alias) where contains(lower(url), alias) group by 1,2""")
def fn27(spark, d):
    hits = text.match_alias("url", REGISTRY)
    return table(spark, d, "pages").select("page_id", F.explode(hits).alias("client"))


@query("fn28_is_hallucination", f"""select doc_id, n, len(t)>12 and len(list_distinct(t))<=3 as degenerate from
    (select doc_id, len(t) as n, t from (select doc_id, {_TOKENS.format('text')} as t from documents))""")
def fn28(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.size(text.tokens("text")).alias("n"), text.is_hallucination("text").alias("degenerate")
    )


@query("fn29_join_split_tokens", with_("word", """, g as (select *, sum(case when regexp_matches(word,'^[-%]') then 0 else 1 end)
      over (partition by media_id order by seq) as island from word),
    j as (select media_id, island, min(seq) as seq, string_agg(word,'' order by seq) as word, max(e) as e, count(*) as parts
      from g group by 1,2)
    select media_id, count(*) as words, count(*) filter (parts>1) as glued,
      cast(sum(length(word)*(seq%97+1)) as bigint) as spelled, max(e) as last_end from j group by 1"""))
def fn29(spark, d):
    joined = words.join_split_tokens(B.word(spark, d))
    return joined.groupBy("media_id").agg(
        F.count("*").alias("words"),
        F.sum(F.when(F.col("parts") > 1, 1).otherwise(0)).alias("glued"),
        F.sum(F.length("word") * (F.col("seq") % 97 + 1)).alias("spelled"),
        F.max("e").alias("last_end"),
    )


@query("fn30_slice_words", f"""select doc_id, case when f1-f0>=0.85::double then array_to_string(t,' ')
      when i1>i0 then array_to_string(t[i0+1:greatest(i0+1,i1)],' ') else '' end as part
    from (select doc_id, t, f0, f1, cast(floor(len(t)*f0) as int) as i0, cast(round_even(len(t)*f1,0) as int) as i1 from
      (select doc_id, {_TOKENS.format('text')} as t, (doc_id%10)/20.0::double as f0, (doc_id%7+3)/10.0::double as f1 from documents))""")
def fn30(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("w"))
    part = text.slice_words("w", (F.col("doc_id") % 10) / 20.0, (F.col("doc_id") % 7 + 3) / 10.0)
    return docs.select("doc_id", F.array_join(part, " ").alias("part"))


@query("fn31_to_frame", with_("interval", """select event_id, cast(round(s*30) as bigint) as f0, cast(round(e*25) as bigint) as f1 from "interval" """))
def fn31(spark, d):
    return B.interval(spark, d).select("event_id", time.to_frame("s", 30).alias("f0"), time.to_frame("e", 25).alias("f1"))


@query("fn32_quantise", """select p_partkey, greatest(920.0::double, least(1900.0::double, round(p_retailprice/25.0::double)*25.0::double)) as q from part""")
def fn32(spark, d):
    return table(spark, d, "part").select("p_partkey", time.quantise("p_retailprice", 25.0, 920.0, 1900.0).alias("q"))
