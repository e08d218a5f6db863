"""The relations of the library, derived from the given tables.

``SQL`` holds the same relations as common table expressions for the comparison texts; ``with_``
prefixes a text with the ones it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.signal import norm2
from cuewright.operators.slices import Layout, position
from cuewright.session import written

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "[ \n\t\r]+").alias("w"))
    return (
        # The outer form lets no filter on the words of a text below it, which would split the text twice.
        docs.select(F.col("doc_id").alias("media_id"), F.posexplode_outer("w").alias("seq", "word"))
        .filter("word <> ''")
        .select(
            "media_id",
            F.col("seq").cast("bigint").alias("seq"),
            "word",
            F.round(F.col("seq") * 0.4, 3).alias("s"),
            F.round(F.col("seq") * 0.4 + F.length("word") * 0.05, 3).alias("e"),
        )
    )


def keep(spark, d) -> DataFrame:
    a = F.col("k") * F.lit(12.0) + F.col("doc_id") % 3
    last = F.floor((F.size(F.split("text", "[ \n\t\r]+")) - 1) / 30)  # 30 words last 12 seconds
    return (
        table(spark, d, "documents")
        .select("doc_id", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))  # as in word
        .filter("k is not null")
        .select(F.col("doc_id").alias("media_id"), a.alias("s"), (a + 8).alias("e"))
    )


def caption(spark, d) -> DataFrame:
    s = (F.col("turn") * 10).cast("double")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("clip_id"),
        F.col("turn").alias("seq"),
        s.alias("s"),
        (F.col("turn") * 10 + F.length("text") / (20 + 10 * (F.col("turn") % 4)).cast("double")).alias("e"),
        "text",
    )


def interval(spark, d) -> DataFrame:
    s = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("media_id"),
        F.col("event_type").alias("kind"),
        F.col("event_id"),
        s.cast("double").alias("s"),
        (s + F.col("value")).alias("e"),
    )


def _framed(spark, d, *values) -> DataFrame:
    lines = table(spark, d, "lineitem")
    layout = Layout(("l_suppkey",), LINE_ORDER, width=1 << 16)
    return position(lines, layout, "frame").select(
        F.col("l_suppkey").alias("media_id"), "frame", *values
    )


def level(spark, d) -> DataFrame:
    return _framed(spark, d, (F.col("l_quantity") - 60).cast("double").alias("db"))


def _diff():
    return (F.col("l_quantity") + F.col("l_discount") * 100).cast("double").alias("diff")


def frame_diff(spark, d) -> DataFrame:
    return _framed(spark, d, _diff())


def _face_x():
    return (F.col("l_partkey") * 97 % 1920).cast("double").alias("x")


def diff_face(spark, d) -> tuple[DataFrame, DataFrame]:
    """``frame_diff`` and the positions of ``face``, numbered in one pass and written."""
    both = written(_framed(spark, d, _diff(), _face_x()))
    return both.select("media_id", "frame", "diff"), both.select("media_id", "frame", "x")


def face(spark, d) -> DataFrame:
    return _framed(
        spark,
        d,
        (F.col("frame") * 500).alias("t_ms"),
        _face_x(),
        (F.col("l_quantity") * 8 + 40).alias("w"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_tax") * 1000).alias("sharp"),
    )


def speaker_window(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") % 10).alias("media_id"),
        (F.floor(F.col("vec_id") / 10) * 100).alias("t_ms"),
        F.col("label").alias("cluster"),
        "embedding",
    )


def post(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    qty = F.col("l_quantity").cast("bigint")
    lines = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(qty).alias("likes"),
            F.count("*").alias("comments"),
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", qty)), F.lit(0)).alias("saves"),
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", qty)), F.lit(0)).alias("shares"),
        )
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("platform"),
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderdate").cast("date").alias("published_at"),
        F.col("o_orderstatus").alias("format"),
        F.floor("o_totalprice").alias("reach"),
        "likes", "comments", "saves", "shares",
    )


def account_metric(spark, d) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, d, "orders")
        .groupBy(
            (F.col("o_custkey") % 5).alias("client"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
            F.col("o_orderpriority").alias("metric"),
        )
        .agg((F.sum(cents) / 100.0).alias("value"))
    )


def file(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"),
        F.col("n_chars").alias("size"),
        F.md5(F.col("text").cast("binary")).alias("hash"),
    )


def feedback(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id"),
        F.col("ts"),
        F.col("ts").cast("date").alias("date"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("category"),
        F.col("props").alias("text"),
    )


def photo(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_brand").alias("series"),
        F.col("p_partkey").alias("file"),
        (F.col("p_size") * F.lit(0.7) + 105).alias("skin_angle"),
        (F.col("p_retailprice") / 10000).alias("skin_chroma"),
        (F.col("p_size") % 4).alias("faces"),
    )


def probe(spark, d) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("clip_id"),
        F.when(size % 7 == 0, 720).otherwise(1080).alias("width"),
        F.lit(1920).alias("height"),
        F.when(size % 5 == 0, 24.0).otherwise(30.0).alias("fps"),
        (size % 10 - 20).cast("double").alias("lufs"),
        (size % 4 - 3).cast("double").alias("true_peak"),
        (F.col("p_retailprice") / 20).alias("duration"),
    )


def turn(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("idx"), "role", "text",
        F.length("text").cast("bigint").alias("output_tokens"),
    )


def turn_word(spark, d) -> DataFrame:
    """Words of each conversation turn, one clip per turn."""
    turns = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("clip_id"),
        F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "").alias("w"),
    )
    return turns.select("clip_id", F.posexplode("w").alias("seq", "word")).select(
        "clip_id",
        F.col("seq").cast("bigint").alias("seq"),
        "word",
        F.round(F.col("seq") * 0.4, 3).alias("s"),
        F.round(F.col("seq") * 0.4 + F.length("word") * 0.05, 3).alias("e"),
    )


def unit_vectors(windows: DataFrame) -> DataFrame:
    """Speaker windows with vectors of length one."""
    n = norm2("embedding")
    return windows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / n))


_LINES = ", ".join(LINE_ORDER)
_FRAME = f"row_number() over (partition by l_suppkey order by {_LINES}) - 1"

# Relation name -> (needed relations, text).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "word": ((), """
      word as (select media_id, seq, word, round(seq*0.4::double,3) as s,
                      round(seq*0.4::double + 0.05::double*length(word),3) as e
        from (select doc_id as media_id, unnest(w) as word, generate_subscripts(w,1)-1 as seq
              from (select doc_id, string_split_regex(text,'[ \n\t\r]+') as w from documents))
        where word <> '')"""),
    "turn_word": ((), """
      turn_word as (select clip_id, seq, word, round(seq*0.4::double,3) as s,
          round(seq*0.4::double + 0.05::double*length(word),3) as e, length(word) as len,
          sum(length(word)) over (partition by clip_id order by seq) as cum, count(*) over (partition by clip_id) as n
        from (select clip_id, unnest(w) as word, generate_subscripts(w,1)-1 as seq from
          (select conv_id||'-'||turn as clip_id, list_filter(string_split_regex(text,'[ \n\t\r]+'), lambda x: x<>'') as w
           from conversations)))"""),
    "keep": ((), """
      keep as (select doc_id as media_id, k*12.0::double+doc_id%3 as s, k*12.0::double+doc_id%3+8 as e
        from (select doc_id, unnest(range((len(string_split_regex(text,'[ \n\t\r]+'))-1)//30+1)) as k from documents))"""),
    "caption": ((), """
      caption as (select conv_id as clip_id, turn as seq, cast(turn*10 as double) as s,
          turn*10+length(text)/cast(20+10*(turn%4) as double) as e, text from conversations)"""),
    "interval": ((), """
      "interval" as (select user_id as media_id, event_type as kind, event_id,
          cast(floor(epoch(ts)) - epoch(timestamp '2024-01-01') as double) as s,
          cast(floor(epoch(ts)) - epoch(timestamp '2024-01-01') as double) + value as e from events)"""),
    "level": ((), f"""
      level as (select l_suppkey as media_id, {_FRAME} as frame, cast(l_quantity-60 as double) as db
        from lineitem)"""),
    "frame_diff": ((), f"""
      frame_diff as (select l_suppkey as media_id, {_FRAME} as frame,
          cast(l_quantity+l_discount*100 as double) as diff from lineitem)"""),
    "face": ((), f"""
      face as (select media_id, frame, frame*500 as t_ms, x, w, score, sharp from (
        select l_suppkey as media_id, {_FRAME} as frame, cast(l_partkey*97%1920 as double) as x,
          l_quantity*8+40 as w, l_discount*10 as score, l_tax*1000 as sharp from lineitem))"""),
    "speaker_window": ((), """
      speaker_window as (select vec_id%10 as media_id, cast(floor(vec_id/10)*100 as bigint) as t_ms,
          label as cluster, embedding from embeddings)"""),
    "post": ((), """
      post as (select o_orderpriority as platform, o_orderkey as post_id, cast(o_orderdate as date) as published_at,
          o_orderstatus as format, cast(floor(o_totalprice) as bigint) as reach,
          cast(sum(l_quantity) as bigint) as likes, count(*) as comments,
          cast(coalesce(sum(l_quantity) filter (l_returnflag='R'),0) as bigint) as saves,
          cast(coalesce(sum(l_quantity) filter (l_returnflag='A'),0) as bigint) as shares
        from orders join lineitem on o_orderkey=l_orderkey group by 1,2,3,4,5)"""),
    "account_metric": ((), """
      account_metric as (select o_custkey%5 as client, strftime(o_orderdate,'%Y-%m') as month,
          o_orderpriority as metric, sum(cast(round(o_totalprice*100) as bigint))/100.0::double as value
        from orders group by 1,2,3)"""),
    "file": ((), """
      file as (select source||'/'||lang||'/doc_'||doc_id||'.txt' as path, n_chars as size, md5(text) as hash
        from documents)"""),
    "feedback": ((), """
      feedback as (select event_id, ts, cast(ts as date) as date, user_id as client, event_type as category,
          props as text from events)"""),
    "photo": ((), """
      photo as (select p_brand as series, p_partkey as file, p_size*cast(0.7 as double)+105 as skin_angle,
          p_retailprice/10000 as skin_chroma, p_size%4 as faces from part)"""),
    "probe": ((), """
      probe as (select p_partkey as clip_id, case when p_size%7=0 then 720 else 1080 end as width,
          1920 as height, cast(case when p_size%5=0 then 24 else 30 end as double) as fps,
          cast(p_size%10-20 as double) as lufs, cast(p_size%4-3 as double) as true_peak,
          p_retailprice/20 as duration from part)"""),
    "turn": ((), """
      turn as (select conv_id as session, turn as idx, role, text, length(text) as output_tokens
        from conversations)"""),
}


def with_(names: str, text: str) -> str:
    """``text`` preceded by the named relations; a text that starts with a relation list of its
    own (``, x as (...) select``) continues the list."""
    ctes = ",".join(SQL[n][1] for n in names.split())
    return f"with {ctes} {text}"
