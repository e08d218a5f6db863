"""Writers. Outputs are laid out by entity; no writer gathers an entity in one task."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.time import fmt_seconds
from cuewright.operators.slices import Layout, position
from cuewright.sources import commits
from cuewright.sources.logs import FEEDBACK_SCHEMA, feedback_columns

REPORT_ROWS = 10_000


def srt_blocks(df: DataFrame, layout: Layout = Layout(("media_id",), ("seq",))) -> DataFrame:
    """Numbered subtitle blocks as text, one row per cue."""
    numbered = position(df, layout, "_n")
    block = F.concat(
        (F.col("_n") + 1).cast("string"), F.lit("\n"), fmt_seconds("s", "srt"), F.lit(" --> "),
        fmt_seconds("e", "srt"), F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    return numbered.select(*layout.key, "_n", block.alias("value"))


def write_srt(df: DataFrame, path: str, files: int | None = None) -> None:
    """Subtitle text under one folder per recording; the files of a folder are in cue order, so a
    long recording is several files and never one task."""
    blocks = srt_blocks(df)
    ranged = blocks.repartitionByRange(files, "media_id", "_n") if files else blocks.repartitionByRange("media_id", "_n")
    ranged.sortWithinPartitions("media_id", "_n").select("media_id", "value").write.mode("overwrite").partitionBy(
        "media_id"
    ).text(path)


def review_rows(captions: DataFrame, fps: int = 30, lead: float = 1.0) -> DataFrame:
    """Review sheet: clip, timecode with frames, seconds, text and emphasised words. The timecode
    counts the one-second cover in front of the delivered file."""
    flagged = F.filter("w", lambda x, i: F.coalesce(F.get("em", i), F.lit(False)))
    return captions.select(
        F.col("clip_id").alias("clip"), fmt_seconds(F.col("s") + lead, "frames", fps).alias("final_tc"),
        F.round("s", 2).alias("final_s"), "text", F.array_join(flagged, " ").alias("emph"),
    )


def write_review(captions: DataFrame, path: str) -> None:
    review_rows(captions).repartitionByRange("clip", "final_s").sortWithinPartitions("clip", "final_s").write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def findings_report(df: DataFrame, key: Sequence[str] = ("clip_id",), order: str = "seq", rows: int = REPORT_ROWS) -> DataFrame:
    """Findings nested per entity, in parts of bounded size."""
    layout = Layout(tuple(key), (order, "severity", "code"))
    numbered = position(df, layout, "_n")
    body = F.struct(*[F.col(c) for c in df.columns if c not in key])
    return (
        numbered.groupBy(*key, F.floor(F.col("_n") / rows).alias("part"))
        .agg(
            F.count_if(F.col("severity") == "error").alias("errors"),
            F.count_if(F.col("severity") == "warning").alias("warnings"),
            F.sort_array(F.collect_list(F.struct("_n", body.alias("finding")))).alias("_f"),
        )
        .select(*key, "part", "errors", "warnings", F.transform("_f", lambda x: x["finding"]).alias("findings"))
    )


def write_findings(df: DataFrame, path: str, key: Sequence[str] = ("clip_id",)) -> None:
    findings_report(df, key).write.mode("overwrite").json(path)


def _feedback_lines(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("date").alias("data"), F.col("client").alias("cliente"), F.col("category").alias("categoria"),
        F.col("text").alias("texto"), F.col("skill").alias("skill"), F.col("action").alias("acao"),
    )


def append_feedback(df: DataFrame, path: str) -> None:
    _feedback_lines(df).write.mode("append").json(path)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Feedback rows as JSON lines under a batch id (letters, digits, ``-``, ``_``), once: a batch that is committed is
    skipped (false), so a job that died or was tried again adds nothing twice. Rows count from the moment their commit
    file names their folder; folders of tries that did not get there are never read."""
    spark = df.sparkSession
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"batch id {batch!r}")
    commit = f"{path}/_commits/{batch}"
    if commits.held(spark, commit):
        return False
    folder = f"{batch}.{uuid.uuid4().hex}"
    _feedback_lines(df).write.json(f"{path}/{folder}")
    if commits.held(spark, commit) == "":
        commits.discard(spark, commit)
    return commits.claim(spark, commit, folder)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed batches, with the batch id; no rows where nothing is committed."""
    files = {b: commits.held(spark, f"{path}/_commits/{b}") for b in commits.names(spark, f"{path}/_commits") if not b.startswith(".")}
    folders = [f"{path}/{folder}" for folder in files.values() if folder]
    if not folders:
        return feedback_columns(spark.createDataFrame([], FEEDBACK_SCHEMA)).withColumn("batch", F.lit(None).cast("string"))
    lines = spark.read.schema(FEEDBACK_SCHEMA).json(folders).withColumn("batch", F.regexp_extract("_metadata.file_path", r"/([\w-]+)\.[0-9a-f]{32}/[^/]*$", 1))
    return feedback_columns(lines, "batch")


# Calendar sheet columns in order, and the production columns always present (fixed values).
CALENDAR_COLUMNS = (
    "date", "hour", "platform", "format", "pillar", "funnel", "theme", "hook", "structure", "cta", "metric",
    "excerpt", "origin", "status", "owner", "link",
)
PRODUCTION_COLUMNS = ("status", "owner", "link")


def calendar_sheet(df: DataFrame) -> DataFrame:
    """Calendar columns that hold something plus the production columns; lists on lines."""
    present = [c for c in CALENDAR_COLUMNS if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first() if present else {}
    out = []
    for c in CALENDAR_COLUMNS:
        if c in present and (counts[c] or c in PRODUCTION_COLUMNS):
            cell = F.array_join(c, "\n") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
            out.append(F.coalesce(cell, F.lit("")).alias(c))
        elif c in PRODUCTION_COLUMNS:
            out.append(F.lit("").alias(c))
    return df.select(*out)


def write_calendar(df: DataFrame, path: str) -> None:
    calendar_sheet(df).write.mode("overwrite").option("header", True).csv(path)


def upsert_history(history: DataFrame, month_rows: DataFrame, key: Sequence[str] = ("client", "month")) -> DataFrame:
    """History with the given months replaced and all others kept."""
    fresh = month_rows.select(*key).distinct()
    return history.join(fresh, list(key), "left_anti").unionByName(month_rows)


def write_history(history: DataFrame, path: str) -> None:
    """Only the months present in ``history`` are rewritten."""
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


class StaleCatalogue(Exception):
    """The catalogue was saved by someone else since it was read."""


def catalog_version(spark: SparkSession, path: str) -> int:
    """Number of the latest whole snapshot, 0 before the first."""
    return max((int(n) for n in commits.names(spark, f"{path}/_versions") if n.isdigit() and commits.held(spark, f"{path}/_versions/{n}")), default=0)


def save_catalog(assets: DataFrame, path: str, parent: int | None = None) -> int:
    """Saves a snapshot and returns its version; earlier ones stay, so a job that fails loses nothing, and ``assets``
    may be read from ``path`` itself. ``parent`` is the version that the assets were made from (default: the
    latest); if another save came between, this one is refused with :class:`StaleCatalogue`. A version file without
    text counts as left by a save that died; one seen in the moment between its creation and its text does too."""
    spark = assets.sparkSession
    parent = catalog_version(spark, path) if parent is None else parent
    folder = uuid.uuid4().hex
    assets.write.partitionBy("type").parquet(f"{path}/{folder}")
    torn = [int(n) for n in commits.names(spark, f"{path}/_versions") if n.isdigit() and not commits.held(spark, f"{path}/_versions/{n}")]
    if catalog_version(spark, path) != parent or not commits.claim(spark, f"{path}/_versions/{max([parent, *torn]) + 1:010d}", folder):
        raise StaleCatalogue(f"made from version {parent} of {path}, which is no longer the latest")
    return max([parent, *torn]) + 1


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot of the catalogue, the latest by default."""
    version = catalog_version(spark, path) if version is None else version
    folder = commits.held(spark, f"{path}/_versions/{version:010d}")
    if not folder:
        raise ValueError(f"{path} has no version {version}")
    return spark.read.parquet(f"{path}/{folder}")
