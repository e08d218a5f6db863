"""Readers of logs, registries, jobs, histories and detector output."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.slices import Layout, position
from cuewright.sources.transcripts import whole_files

FEEDBACK_SCHEMA = "data date, cliente string, categoria string, texto string, skill string, acao string"
TURN_SCHEMA = (
    "type string, sessionId string, timestamp timestamp, message struct<usage: struct<output_tokens: bigint, "
    "cache_read_input_tokens: bigint>, content: array<struct<type: string, name: string, input: map<string,string>>>>"
)
CLIP_SCHEMA = (
    "map<string, struct<src: string, master_in: double, headline: string, cropx: double, cover_t: double, "
    "keeps: array<array<double>>>>"
)
HISTORY_SCHEMA = "struct<cliente: string, meses: map<string, struct<rotulo: string, metricas: map<string,double>>>>"
REGISTRY_SCHEMA = "map<string, struct<aliases: array<string>, skill: string, note: string>>"


def feedback_columns(df: DataFrame, *more: str) -> DataFrame:
    names = dict(data="date", cliente="client", categoria="category", texto="text", skill="skill", acao="action")
    return df.select(*[F.col(old).alias(new) for old, new in names.items()], *more)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback log, one JSON object per line; blank lines are skipped."""
    return feedback_columns(spark.read.schema(FEEDBACK_SCHEMA).json(path))


def parse_feedback(df: DataFrame) -> DataFrame:
    """The same from a ``line`` column."""
    rows = df.filter(F.trim("line") != "").select(F.from_json("line", FEEDBACK_SCHEMA).alias("j"))
    return feedback_columns(rows.select("j.*"))


def _turns(df: DataFrame) -> DataFrame:
    tools = F.filter(F.coalesce("message.content", F.array()), lambda c: c["type"] == "tool_use")
    return df.filter("type = 'assistant'").select(
        F.col("sessionId").alias("session"), F.col("timestamp").alias("ts"),
        F.coalesce("message.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("message.usage.cache_read_input_tokens", F.lit(0)).alias("cache_read"),
        F.transform(tools, lambda c: F.struct(c["name"].alias("name"), c["input"].alias("input"))).alias("tools"),
    )


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Assistant turns of session logs in time order; malformed lines are skipped."""
    raw = spark.read.schema(TURN_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return number_turns(_turns(raw))


def parse_turns(df: DataFrame) -> DataFrame:
    rows = df.select(F.from_json("line", TURN_SCHEMA, {"mode": "PERMISSIVE"}).alias("j")).filter("j.type is not null")
    return number_turns(_turns(rows.select("j.*")))


def number_turns(turns: DataFrame) -> DataFrame:
    timed = turns.withColumn("_at", F.unix_micros("ts") / 1e6)
    layout = Layout(("session",), ("_at", "output_tokens", "cache_read"), 86400.0)
    return position(timed, layout, "idx").drop("_at")


def parse_registry(df: DataFrame) -> DataFrame:
    """Registry JSON in ``content`` to one row per client and alias."""
    m = F.from_json("content", REGISTRY_SCHEMA)
    return df.select(F.explode(m).alias("client", "v")).select("client", F.explode("v.aliases").alias("alias"), "v.skill")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(whole_files(spark, path))


# Names that the columns of a licence manifest go by (fixed values).
LICENCE_COLUMNS = dict(
    file=("arquivo", "file"), item_id=("mixkit_id", "item_id", "id"), title=("titulo", "title"), source=("fonte", "source"),
    url=("url_item", "url"), licence=("licenca", "licence", "license"), licence_url=("url_licenca", "licence_url", "license_url"),
)


def parse_licences(df: DataFrame, key: Sequence[str] = ("manifest",)) -> DataFrame:
    """Licence rows of CSV lines (``key``, ``seq``, ``line``), whose header is the line of seq 0 of each manifest.

    Columns are found by name, wherever they stand, and unknown ones are left out. A bad line is kept with
    its ``problem``: ``fields`` (not as many as the header has), ``quote`` (a quote that is not closed), ``file``
    (names no file), ``header`` (its manifest has none). Blank lines are skipped; a field is on one line.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), F.rtrim(F.regexp_replace("line", "^\ufeff|\r$", ""))), F.lit(',("(?:[^"]|"")*"(?=,|$)|[^,]*)'), F.lit(1))
    plain = lambda x: F.trim(F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = df.filter(F.trim("line") != "").select(*key, "seq", raw.alias("_raw"))
    rows = rows.withColumn("_torn", F.exists("_raw", lambda x: x.startswith('"') & ~(x.endswith('"') & (F.length(x) > 1)))).withColumn("_v", F.transform("_raw", plain))
    heads = rows.filter("seq = 0").select(*key, F.transform("_v", F.lower).alias("_names"))
    both = rows.filter("seq > 0").join(heads, list(key), "left")

    def named(aliases):
        at = F.coalesce(*[F.nullif(F.array_position("_names", n), F.lit(0)) for n in aliases])
        return F.nullif(F.get("_v", (at - 1).cast("int")), F.lit(""))

    got = both.select(*key, "seq", *[named(a).alias(c) for c, a in LICENCE_COLUMNS.items()], "_names", "_v", "_torn")
    problem = F.when(F.col("_names").isNull(), "header").when(F.col("_torn"), "quote").when(F.size("_v") != F.size("_names"), "fields").when(F.col("file").isNull(), "file")
    return got.withColumn("problem", problem).drop("_names", "_v", "_torn")


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """Licence manifests (small CSV files, any number), one row per line behind the header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("manifest"), "value")
    return parse_licences(files.select("manifest", F.posexplode(F.split("value", "\n")).alias("seq", "line")))


def unlicensed(uses: DataFrame, licences: DataFrame) -> DataFrame:
    """Uses (``file`` and any columns) of files that no good line of a manifest covers; letter case does not count."""
    good = licences.filter("problem is null").select(F.lower("file").alias("_f")).distinct()
    return uses.join(good, F.lower("file") == F.col("_f"), "left_anti")


def _detected(kind: str):
    start = F.regexp_extract_all("log", F.lit(rf"{kind}_start:\s*(-?[\d.]+)"), F.lit(1))
    end = F.regexp_extract_all("log", F.lit(rf"{kind}_end:\s*(-?[\d.]+)"), F.lit(1))

    def pair(x, i):
        stop = F.get(end, i).cast("double")
        return F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("s"), stop.alias("e"))

    return F.transform(start, pair)


def parse_detector_log(df: DataFrame, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """Black, freeze and silence intervals from detector output in ``log``; an interval that never
    ends runs to ``duration``."""
    parts = [_detected(kind) for kind in ("black", "freeze", "silence")]
    rows = df.select(*key, "duration", F.explode(F.concat(*parts)).alias("d"))
    return rows.select(*key, "d.kind", "d.s", F.coalesce("d.e", "duration").alias("e"))


def parse_loudness(df: DataFrame, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """Last integrated loudness and last true peak in ``log``."""
    def last(pattern: str):
        found = F.regexp_extract_all("log", F.lit(pattern), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("double")

    return df.select(*key, last(r"\bI:\s*(-?[0-9.]+) LUFS").alias("lufs"), last(r"Peak:\s*(-?[0-9.]+) dBFS").alias("true_peak"))


def parse_jobs(df: DataFrame, profile: dict | None = None) -> DataFrame:
    """Cut jobs in ``content`` to one row per clip: keeps, attributes, corrections and emphasis.

    A profile fills in what the job leaves out; its corrections and emphasis words are added.
    """
    job = F.from_json("content", "map<string,string>")
    base = {k: v for k, v in (profile or {}).items() if k not in ("fix", "emph")}
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in base.items()}
    attrs = F.map_filter(job, lambda k, _: ~k.isin("clips", "fix", "emph"))
    if texts:
        defaults = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
        attrs = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(job, k)), attrs)
    fix = F.coalesce(F.from_json(job["fix"], "array<array<string>>"), F.array())
    emph = F.coalesce(job["emph"], F.lit(""))
    if profile and profile.get("fix"):
        fix = F.concat(fix, F.array(*[F.array(*[F.lit(x) for x in pair]) for pair in profile["fix"]]))
    if profile and profile.get("emph"):
        emph = F.concat_ws(" ", F.nullif(emph, F.lit("")), F.lit(profile["emph"]))
    others = [c for c in df.columns if c != "content"]
    rows = df.select(*others, attrs.alias("attrs"), fix.alias("fix"), emph.alias("emph"), F.explode(F.from_json(job["clips"], CLIP_SCHEMA)).alias("clip_id", "c"))
    keeps = F.transform(F.col("c.keeps"), lambda k: F.struct(F.get(k, F.lit(0)).alias("s"), F.get(k, F.lit(1)).alias("e")))
    return rows.select(*others, "clip_id", "c.src", "c.master_in", "c.headline", keeps.alias("keeps"), "attrs", "fix", "emph")


def read_jobs(spark: SparkSession, glob: str, profile: dict | None = None) -> DataFrame:
    return parse_jobs(whole_files(spark, glob).withColumnRenamed("media_id", "job"), profile)


def parse_history(df: DataFrame) -> DataFrame:
    """Monthly history JSON in ``content`` to long metrics."""
    h = df.select(F.from_json("content", HISTORY_SCHEMA).alias("h"))
    months = h.select(F.col("h.cliente").alias("client"), F.explode("h.meses").alias("month", "m"))
    return months.select("client", "month", F.explode("m.metricas").alias("metric", "value"))


def read_history(spark: SparkSession, glob: str) -> DataFrame:
    return parse_history(whole_files(spark, glob))
