"""File inventories, signal chunks and social exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.signal import to_db
from cuewright.operators.slices import Layout, running

HEAD_BYTES = 4 << 20


def visible(files: DataFrame, path: str = "path") -> DataFrame:
    """Files without system litter."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return files.filter(~name.isin(*K.SKIPPED_FILES) & ~name.startswith("._"))


def scan_files(spark: SparkSession, roots: Sequence[str], hashes: bool = False) -> DataFrame:
    """Recursive inventory without system litter. File bytes are read only for ``hashes``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    seen = visible(raw)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if hashes:
        columns += [F.sha2("content", 256).alias("hash"), quick_hash("content", "length").alias("qhash")]
    return seen.select(*columns)


def quick_hash(content: str, size: str):
    """First 20 hex digits of SHA-256 over the size and the first and last 4 MB (the whole file
    when it has no more than 8 MB)."""
    body = F.col(content)
    n = F.col(size)
    ends = F.concat(F.substring(body, 1, HEAD_BYTES), F.substring(body, -HEAD_BYTES, HEAD_BYTES))
    part = F.when(n <= 2 * HEAD_BYTES, body).otherwise(ends)
    return F.substring(F.sha2(F.concat(n.cast("string").cast("binary"), part), 256), 1, 20)


def level_frames(pcm: DataFrame, hop: int, hop_ms: int | None = None) -> DataFrame:
    """Signal chunks ``pcm(media_id, chunk, samples)`` to one level per ``hop`` samples.

    Chunks may have any length, and a frame may lie across several: each chunk knows how many samples
    came before it, yields its part of every frame it touches, and the parts are added up. Samples
    after the last whole frame of a recording make no frame.
    """
    sized = running(pcm.withColumn("_n", F.size("samples")).filter("_n > 0"), Layout(("media_id",), ("chunk",), 1 << 12), {"_to": ("sum", "_n")})
    start = F.col("_to") - F.col("_n")
    scaled = F.transform("samples", lambda x: x.cast("double") / F.lit(32768.0))
    square = lambda acc, x: acc + x * x
    touched = F.sequence(F.floor(start / hop).cast("bigint"), F.floor((F.col("_to") - 1) / hop).cast("bigint"))

    def part(f):
        low = F.greatest(f * hop, start)
        n = F.least((f + 1) * hop, F.col("_to")) - low
        return F.struct(f.alias("frame"), n.alias("n"), F.aggregate(F.slice("_x", (low - start + 1).cast("int"), n.cast("int")), F.lit(0.0), square).alias("sum"))

    parts = sized.withColumn("_x", scaled).select("media_id", F.explode(F.transform(touched, part)).alias("p")).select("media_id", "p.*")
    whole = parts.groupBy("media_id", "frame").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).filter(F.col("n") == hop)
    out = whole.select("media_id", "frame", to_db(F.col("sum") / hop).alias("db"))
    return out if hop_ms is None else out.withColumn("hop_ms", F.lit(hop_ms))


POST_COLUMNS = (
    "account", "post_id", "published_at", "format", "text", "link", "views", "reach", "likes", "comments",
    "saves", "shares", "follows",
)
COUNT_COLUMNS = ("views", "reach", "likes", "comments", "saves", "shares", "follows")


def normalise_posts(raw: DataFrame, platform: str, columns: Mapping[str, str]) -> DataFrame:
    """One platform's export in the common columns; blank cells are null, counts are numbers."""
    out = [F.lit(platform).alias("platform")]
    for name in POST_COLUMNS:
        cell = F.nullif(F.trim(F.col(columns[name])), F.lit("")) if name in columns else F.lit(None).cast("string")
        out.append((cell.try_cast("bigint") if name in COUNT_COLUMNS else cell).alias(name))
    return raw.select(*out)


def read_posts(
    spark: SparkSession,
    exports: Mapping[str, str],
    columns: Mapping[str, Mapping[str, str]],
    account: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """CSV exports per platform (platform -> path, platform -> common name -> file column)."""
    parts = []
    for platform, path in exports.items():
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)
        parts.append(normalise_posts(raw, platform, columns[platform]))
    posts = parts[0]
    for p in parts[1:]:
        posts = posts.unionByName(p)
    if account is not None:
        posts = posts.filter(F.col("account").isNull() | (F.col("account") == account))
    if year is not None:
        posts = posts.filter(F.col("published_at").contains(str(year)))
    return posts


def read_daily_views(spark: SparkSession, path: str, year: int) -> DataFrame:
    """UTF-16 daily series: two-cell rows that start with the year."""
    raw = spark.read.option("encoding", "UTF-16").option("multiLine", True).schema("day string, views string").csv(path)
    return raw.filter(F.col("day").startswith(str(year)) & F.col("views").isNotNull()).select(
        F.substring("day", 1, 10).try_cast("date").alias("day"), F.col("views").try_cast("bigint").alias("views")
    )
