"""Parsers and report rows over text built from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuewright.functions.time import fmt_seconds
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.registry import query
from cuewright.session import ensure_checkpoint_dir
from cuewright.sources import files, logs, sinks, transcripts


def _flat(c="text"):
    """One-line text: what a subtitle line can hold."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


_FLAT = r"trim(regexp_replace(text,'\s+',' ','g'))"


def _srt_text(spark, d, arrow, entity):
    """Two subtitle blocks per conversation turn, in the forms real files take."""
    t = F.when(F.lit(entity), F.replace(_flat(), F.lit("e"), F.lit("&amp;"))).otherwise(_flat())
    block = F.concat(F.lit("1\n"), fmt_seconds("s", "srt"), F.lit(arrow), fmt_seconds("e", "srt"), F.lit("\n<i>"), t, F.lit("</i>"))
    second = F.concat(F.lit("2\r\n"), fmt_seconds("e", "srt"), F.lit(arrow), fmt_seconds(F.col("e") + 1, "srt"), F.lit("\r\nend of <b>turn</b>"))
    return B.caption(spark, d).select(
        F.concat_ws("-", "clip_id", "seq").alias("media_id"),
        F.concat(F.lit("﻿"), block, F.lit("\n \n"), second, F.lit("\n\n3\nno time here\n")).alias("content"),
    )


def _srt_sql(t):
    return with_("caption", f"""select clip_id||'-'||seq as media_id, 0 as seq, round(s,3) as s, round(e,3) as e, {t} as text from caption
      union all select clip_id||'-'||seq, 1, round(e,3), round(e+1,3), 'end of turn' from caption""")


@query("src1_read_srt", _srt_sql(_FLAT))
def src1(spark, d):
    return transcripts.parse_srt(_srt_text(spark, d, " --> ", False))


@query("src2_read_srt_tolerant", _srt_sql(f"replace({_FLAT},'e','&')"))
def src2(spark, d):
    return transcripts.parse_srt(_srt_text(spark, d, "-->", True), tolerant=True)


def _asr(spark, d):
    words = F.transform(
        F.split(_flat(), " "),
        lambda w, i: F.struct(w.alias("word"), (i * 0.4).alias("start"), (i * 0.4 + 0.3).alias("end")),
    )
    halves = F.array(
        F.struct(F.lit(0.0).alias("start"), F.lit(160.0).alias("end"), F.lit("a").alias("text"), words.alias("words")),
        F.struct(F.lit(160.0).alias("start"), F.lit(161.0).alias("end"), F.lit("b").alias("text"),
                 F.array(F.struct(F.lit("fim").alias("word"), F.lit(160.0).alias("start"), F.lit(160.5).alias("end"))).alias("words")),
    )
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("media_id"), F.to_json(F.struct(halves.alias("segments"))).alias("content")
    )


@query("src3_read_asr_words", f"""with t as (select conv_id||'-'||turn as media_id, string_split({_FLAT},' ') as w from conversations),
    x as (select media_id, unnest(w) as word, generate_subscripts(w,1)-1 as seq, len(w) as n from t)
    select media_id, seq, 0 as seg, word, round(seq*0.4::double,6) as s, round(seq*0.4::double+0.3::double,6) as e from x where seq*0.4::double>=1.0 and seq*0.4::double<170
    union all select media_id, len(w), 1, 'fim', 160.0::double, 160.5::double from t""")
def src3(spark, d):
    words = transcripts.parse_asr_words(_asr(spark, d), t0=1.0, t1=170.0)
    return words.withColumn("s", F.round("s", 6)).withColumn("e", F.round("e", 6))


@query("src4_read_segments_tsv", with_("caption", f"select clip_id||'-'||seq as media_id, s, e, {_FLAT} || chr(9) || 'x' as text from caption"))
def src4(spark, d):
    line = F.concat_ws("\t", "s", "e", _flat(), F.lit("x"))
    return transcripts.parse_segments_tsv(
        B.caption(spark, d).select(F.concat_ws("-", "clip_id", "seq").alias("media_id"), line.alias("line"))
    )


@query("src5_read_captions", with_("caption", f"""select clip_id||'-'||seq as clip_id, 0 as seq, s, e, case when seq%2=0 then {_FLAT}||' again' else {_FLAT} end as text,
    seq%2=0 as broken from caption"""))
def src5(spark, d):
    caps = B.caption(spark, d)
    even = F.to_json(F.struct(F.array(F.struct(F.concat(_flat(), F.lit("\n again ")).alias("t"), "s", "e")).alias("caps")))
    odd = F.to_json(F.array(F.struct(_flat().alias("text"), F.col("s").alias("start"), F.col("e").alias("end"))))
    raw = caps.select(
        F.concat_ws("-", "clip_id", "seq").alias("clip_id"), F.when(F.col("seq") % 2 == 0, even).otherwise(odd).alias("content")
    )
    return transcripts.parse_captions(raw).select("clip_id", "seq", "s", "e", "text", F.col("lines").isNotNull().alias("broken"))


@query("src6_normalise_posts", with_("post", """select platform, cast(post_id as varchar) as post_id, format, case when reach%3=0 then null else reach end as reach,
    likes from post where year(published_at)=1996"""))
def src6(spark, d):
    raw = B.post(spark, d).select(
        "platform", F.col("post_id").cast("string").alias("id"), F.col("published_at").cast("string").alias("when"),
        F.col("format").alias("kind"), F.when(F.col("reach") % 3 == 0, " ").otherwise(F.col("reach").cast("string")).alias("reach"),
        F.concat(F.lit(" "), F.col("likes").cast("string")).alias("likes"),
    )
    names = dict(post_id="id", published_at="when", format="kind", reach="reach", likes="likes")
    # One export per platform in real use; here the platform is a column of the same table.
    posts = files.normalise_posts(raw, "any", names)
    keyed = posts.drop("platform").join(raw.select("platform", F.col("id").alias("post_id")), "post_id")
    return keyed.filter(F.col("published_at").contains("1996")).select("platform", "post_id", "format", "reach", "likes")


@query("src7_read_feedback", """select cast(ts as date) as date, cast(user_id as varchar) as client, event_type as category, props as text,
    case when event_id%2=0 then 's1' end as skill, cast(null as varchar) as action from events where event_id%10<>3""")
def src7(spark, d):
    e = table(spark, d, "events")
    obj = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("data"), F.col("user_id").cast("string").alias("cliente"),
        F.col("event_type").alias("categoria"), F.col("props").alias("texto"), F.when(F.col("event_id") % 2 == 0, "s1").alias("skill"),
    ))
    return logs.parse_feedback(e.select(F.when(F.col("event_id") % 10 == 3, "  ").otherwise(obj).alias("line")))


def session_lines(spark, d):
    """Session log lines: one assistant turn per event, some user lines, some broken lines."""
    e = table(spark, d, "events")
    call = F.struct(
        F.lit("tool_use").alias("type"), F.when(F.col("event_id") % 3 == 0, "Read").otherwise("Bash").alias("name"),
        F.create_map(F.lit("file_path"), F.concat(F.lit("/work/r"), F.col("event_id") % 7, F.lit("/f.png")), F.lit("command"), F.col("props")).alias("input"),
    )
    talk = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("input"))
    usage = F.struct((F.col("event_id") % 100).alias("output_tokens"), F.floor(F.col("value")).alias("cache_read_input_tokens"))
    obj = F.to_json(F.struct(
        F.when(F.col("event_id") % 11 == 0, "user").otherwise("assistant").alias("type"),
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("sessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.struct(usage.alias("usage"), F.array(call, talk).alias("content")).alias("message"),
    ))
    return e.select(F.when(F.col("event_id") % 13 == 5, F.substring(obj, 1, 40)).otherwise(obj).alias("line"))


TURN_SQL = """turns as (select 's'||(user_id%20) as session, date_trunc('millisecond', ts) as ts, event_id%100 as output_tokens, cast(floor(value) as bigint) as cache_read,
      event_id, event_id%3=0 as is_read, event_id%7 as target,
      row_number() over (partition by user_id%20 order by date_trunc('millisecond', ts), event_id%100, floor(value))-1 as idx
    from events where event_id%11<>0 and event_id%13<>5)"""


@query("src8_read_turns", f"with {TURN_SQL} select session, idx, output_tokens, cache_read, 1 as calls from turns")
def src8(spark, d):
    turns = logs.parse_turns(session_lines(spark, d))
    return turns.select("session", "idx", "output_tokens", "cache_read", F.size("tools").alias("calls"))


@query("src9_read_registry", """select 'c'||c_custkey as client, unnest(['n'||c_nationkey, c_mktsegment]) as alias, case when c_custkey%2=0 then 'k' end as skill from customer""")
def src9(spark, d):
    c = table(spark, d, "customer")
    entry = F.struct(
        F.array(F.concat(F.lit("n"), "c_nationkey"), "c_mktsegment").alias("aliases"), F.when(F.col("c_custkey") % 2 == 0, "k").alias("skill")
    )
    content = F.to_json(F.create_map(F.concat(F.lit("c"), "c_custkey"), entry))
    return logs.parse_registry(c.select(content.alias("content")))


@query("src12_read_textgrid", f"""with t as (select conv_id||'-'||turn as media_id, string_split({_FLAT},' ') as w from conversations),
    x as (select media_id, unnest(w) as word, generate_subscripts(w,1)-1 as i from t)
    select media_id, 2*i as seq, cast(i as double) as s, i+0.5::double as e, replace(word,'"','') as word, replace(word,'"','')='' as silence from x
    union all select media_id, 2*i+1, i+0.5::double, i+1.0::double, '', true from x""")
def src12(spark, d):
    words = F.split(F.regexp_replace(_flat(), '"', ""), " ")
    def item(a, b, t):
        return F.concat(F.lit("        intervals [1]:\n            xmin = "), a, F.lit("\n            xmax = "), b, F.lit('\n            text = "'), t, F.lit('"'))
    grid = F.array_join(
        F.flatten(F.transform(words, lambda w, i: F.array(
            item(i.cast("string"), (i + 0.5).cast("string"), w), item((i + 0.5).cast("string"), (i + 1).cast("string"), F.lit("")),
        ))), "\n",
    )
    content = F.concat(
        F.lit('File type = "ooTextFile"\n    item [1]:\n        name = "words"\n'), grid,
        F.lit('\n    item [2]:\n        name = "phones"\n        xmin = 0\n            xmax = 9\n            text = "p"\n'),
    )
    return transcripts.parse_textgrid(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("media_id"), content.alias("content")))


@query("src13_parse_detector_log", """select event_id as media_id, unnest(['black','silence']) as kind, unnest([value, value*2]) as s,
    unnest([value+1, case when event_id%2=0 then 1000.0::double else value*2+3 end]) as e from events""")
def src13(spark, d):
    e = table(spark, d, "events")
    v = F.col("value")
    log = F.concat(
        F.lit("[blackdetect @ 0x1] black_start:"), v, F.lit(" black_end:"), v + 1, F.lit(" black_duration:1\n"),
        F.lit("[silencedetect @ 0x2] silence_start: "), v * 2, F.lit("\n"),
        F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("[silencedetect @ 0x2] silence_end: "), v * 2 + 3, F.lit(" | silence_duration: 3\n"))),
    )
    return logs.parse_detector_log(e.select(F.col("event_id").alias("media_id"), F.lit(1000.0).alias("duration"), log.alias("log")))


@query("src13_parse_loudness", "select p_partkey as media_id, cast(p_size%10-20 as double) as lufs, case when p_size%3=0 then null else cast(p_size%4-3 as double) end as true_peak from part")
def src13b(spark, d):
    p = table(spark, d, "part")
    log = F.concat(
        F.lit("t: 1 I: -70.0 LUFS\n  Integrated loudness:\n    I: "), F.col("p_size") % 10 - 20, F.lit(".0 LUFS\n"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("    Peak: "), F.col("p_size") % 4 - 3, F.lit(".0 dBFS\n"))),
    )
    return logs.parse_loudness(p.select(F.col("p_partkey").alias("media_id"), log.alias("log")))


PROFILE = {"crf": 21, "preset": "slow", "fix": [["x", "y"]], "emph": "porto"}


@query("src14_read_jobs", """select p_partkey as job, 'c'||p_size as clip_id, p_name as src, p_retailprice as master_in, 2 as n_keeps, p_retailprice+5 as last_end,
    case when p_partkey%2=0 then '18' else '21' end as crf, 'slow' as preset, 2 as n_fix,
    case when p_partkey%3=0 then p_type||' porto' else 'porto' end as emph from part""")
def src14(spark, d):
    p = table(spark, d, "part")
    price = F.col("p_retailprice")
    clip = F.struct(
        F.col("p_name").alias("src"), price.alias("master_in"),
        F.array(F.array(price, price + 1), F.array(price + 2, price + 5)).alias("keeps"),
    )
    job = F.to_json(F.struct(
        F.create_map(F.concat(F.lit("c"), "p_size"), clip).alias("clips"), F.when(F.col("p_partkey") % 2 == 0, 18).alias("crf"),
        F.array(F.array(F.lit("a"), F.lit("b"))).alias("fix"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("emph"),
    ))
    out = logs.parse_jobs(p.select(F.col("p_partkey").alias("job"), job.alias("content")), PROFILE)
    return out.select(
        "job", "clip_id", "src", "master_in", F.size("keeps").alias("n_keeps"), F.element_at("keeps", -1)["e"].alias("last_end"),
        F.col("attrs")["crf"].alias("crf"), F.col("attrs")["preset"].alias("preset"), F.size("fix").alias("n_fix"), "emph",
    )


@query("src15_read_history", """select 'u'||c_custkey as client, '2024-0'||(c_custkey%9+1) as month, unnest(['bal','nation']) as metric,
    unnest([c_acctbal, cast(c_nationkey as double)]) as value from customer""")
def src15(spark, d):
    c = table(spark, d, "customer")
    metrics = F.create_map(F.lit("bal"), F.col("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("double"))
    months = F.create_map(F.concat(F.lit("2024-0"), F.col("c_custkey") % 9 + 1), F.struct(F.lit("x").alias("rotulo"), metrics.alias("metricas")))
    content = F.to_json(F.struct(F.concat(F.lit("u"), "c_custkey").alias("cliente"), months.alias("meses")))
    return logs.parse_history(c.select(content.alias("content")))


@query("src16_level_frames", """with p as (select vec_id%10 as media_id, cast(floor(vec_id/10) as bigint) as chunk,
      list_transform(embedding, lambda x: cast(trunc(cast(x as double)*32767) as double)/32768) as x from embeddings),
    f as (select media_id, chunk*4+k as frame, list_sum(list_transform(x[k*16+1:k*16+16], lambda v: v*v))/16 as ms from p, (select unnest(range(4)) as k))
    select media_id, frame, round(20*log10(sqrt(ms)+1e-9::double),6) as db from f""")
def src16(spark, d):
    samples = F.transform("embedding", lambda x: (x.cast("double") * 32767).cast("int").cast("smallint"))
    pcm = table(spark, d, "embeddings").select(
        (F.col("vec_id") % 10).alias("media_id"), F.floor(F.col("vec_id") / 10).alias("chunk"), samples.alias("samples")
    )
    return files.level_frames(pcm, hop=16).withColumn("db", F.round("db", 6))


@query("snk1_srt_blocks", with_("caption", f"""select clip_id as media_id, row_number() over (partition by clip_id order by seq)-1 as _n,
    row_number() over (partition by clip_id order by seq) || chr(10) || printf('%02d:%02d:%02d,%03d', a//3600000, a%3600000//60000, a%60000//1000, a%1000) || ' --> ' ||
    printf('%02d:%02d:%02d,%03d', b//3600000, b%3600000//60000, b%60000//1000, b%1000) || chr(10) || {_FLAT} || chr(10) as value
    from (select *, cast(round(s*1000) as bigint) as a, cast(round(e*1000) as bigint) as b from caption)"""))
def snk1(spark, d):
    caps = B.caption(spark, d).withColumn("text", _flat()).withColumnRenamed("clip_id", "media_id")
    return sinks.srt_blocks(caps)


@query("snk2_review_rows", with_("caption", f"""select clip_id as clip, printf('%02d:%02d:%02d:%02d', t//3600, t%3600//60, t%60, 0) as final_tc, s as final_s, text,
    array_to_string(list_filter(string_split({_FLAT},' '), lambda x: length(x)>9),' ') as emph from (select *, cast(s as bigint)+1 as t from caption)"""))
def snk2(spark, d):
    caps = B.caption(spark, d).withColumn("w", F.split(_flat(), " ")).withColumn("em", F.transform("w", lambda x: F.length(x) > 9))
    return sinks.review_rows(caps)


@query("snk6_upsert_history", with_("account_metric", """select client, month, metric, case when month>='1998-01' then value*2 else value end as value from account_metric"""))
def snk6(spark, d):
    hist = B.account_metric(spark, d)
    fresh = hist.filter("month >= '1998-01'").withColumn("value", F.col("value") * 2)
    return sinks.upsert_history(hist, fresh)


def _licence_lines(spark, d):
    """Manifests by part size: those of odd number have their columns moved and one more; some lines are broken."""
    p = table(spark, d, "part")
    odd, key = F.col("p_size") % 2 == 1, F.col("p_partkey")
    title = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""'))
    file = F.concat(F.lit("s"), key, F.lit(".wav"))
    line = F.when(odd, F.concat_ws(",", title, F.lit(""), file, F.col("p_type"))).otherwise(F.concat_ws(",", file, key.cast("string"), title, F.col("p_type")))
    line = F.when(key % 17 == 0, F.concat(line, F.lit(",more"))).when(key % 19 == 0, F.concat(F.lit('"'), line)).otherwise(line)
    head = F.when(odd, "titulo,nota,arquivo,licenca").otherwise("\ufeffarquivo,mixkit_id,titulo,Licenca\r")
    heads = p.select(F.col("p_size").alias("manifest"), F.lit(0).alias("seq"), head.alias("line")).distinct()
    return p.select(F.col("p_size").alias("manifest"), (key + 1).cast("int").alias("seq"), line.alias("line")).unionByName(heads)


_LICENCE_SQL = """licence as (select p_size as manifest, (p_partkey+1)::int as seq, 's'||p_partkey||'.wav' as file, case when p_size%2=0 then cast(p_partkey as varchar) end as item_id,
    p_name||', "'||p_brand||'"' as title, p_type as licence, case when p_partkey%17=0 then 'fields' when p_partkey%19=0 then 'quote' end as problem from part)"""


@query("src10_read_licences", f"""with {_LICENCE_SQL} select manifest, seq, problem, case when problem is null then file end as file, case when problem is null then item_id end as item_id,
    case when problem is null then title end as title, case when problem is null then licence end as licence from licence""")
def src10(spark, d):
    got = logs.parse_licences(_licence_lines(spark, d))
    good = [F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("file", "item_id", "title", "licence")]
    return got.select("manifest", "seq", "problem", *good)


@query("src10_unlicensed_uses", f"""with {_LICENCE_SQL} select l_orderkey, l_linenumber, 'S'||l_partkey||'.WAV' as file from lineitem
    where l_partkey not in (select seq-1 from licence where problem is null)""")
def src10_unlicensed(spark, d):
    uses = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), "l_partkey", F.lit(".WAV")).alias("file"))
    return logs.unlicensed(uses, logs.parse_licences(_licence_lines(spark, d)))


@query("snk4_append_batches", """select cast(ts as date) as date, cast(user_id as varchar) as client, event_type as category, props as text, cast(null as varchar) as skill,
    cast(event_id as varchar) as action, case when event_id%2=0 then 'even' else 'odd' end as batch, true as first_try, false as second_try from events""")
def snk4(spark, d):
    rows = table(spark, d, "events").select(
        F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("category"), F.col("props").alias("text"),
        F.lit(None).cast("string").alias("skill"), F.col("event_id").cast("string").alias("action"), "event_id",
    )
    path = f"{ensure_checkpoint_dir(spark)}/feedback-{uuid.uuid4().hex}"
    first = sinks.append_batch(rows.filter("event_id % 2 = 0"), path, "even") and sinks.append_batch(rows.filter("event_id % 2 = 1"), path, "odd")
    again = sinks.append_batch(rows, path, "even")
    rows.limit(1).write.json(f"{path}/lost.{uuid.uuid4().hex}")  # a try that died before its commit
    return sinks.read_batches(spark, path).withColumn("first_try", F.lit(first)).withColumn("second_try", F.lit(again))


@query("snk7_save_catalog", "select p_partkey as id, p_brand as type, p_name||' v2' as name, 2 as version, true as refused from part")
def snk7(spark, d):
    path = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    read = sinks.save_catalog(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name")), path)
    assets = sinks.read_catalog(spark, path)
    sinks.save_catalog(assets.withColumn("name", F.concat("name", F.lit(" v2"))), path, parent=read)
    try:
        sinks.save_catalog(assets, path, parent=read)
        refused = False
    except sinks.StaleCatalogue:
        refused = True
    latest = sinks.read_catalog(spark, path).withColumn("version", F.lit(sinks.catalog_version(spark, path)))
    return latest.withColumn("refused", F.lit(refused))
