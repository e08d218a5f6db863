"""Structured Streaming over the append-only inputs: feedback, caption files, keyword hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuewright.operators.gates import caption_qc

CAPTION_ROWS = "clip_id string, hash string, seq bigint, s double, e double, text string"


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def feedback_counts(entries: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Corrections per day, client and category; entries later than ``late`` are let go. Works on
    a stream and on a table alike."""
    rows = entries.withWatermark(time, late) if entries.isStreaming else entries
    day = F.window(time, "1 day")
    return rows.groupBy(day.alias("w"), "client", "category").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day"), "client", "category", "n"
    )


def keyword_sessions(hits: DataFrame, gap: str, time: str = "ts", key: Sequence[str] = ("client",), late: str = "1 hour") -> DataFrame:
    """Sessions of hits less than ``gap`` apart. Session windows also join hits exactly ``gap``
    apart, so callers pass a gap shortened by the clock's smallest step."""
    rows = hits.withWatermark(time, late) if hits.isStreaming else hits
    return rows.groupBy(F.session_window(time, gap).alias("w"), *key).agg(
        F.count("*").alias("hits"), F.max(time).alias("last")
    ).select(*key, F.col("w.start").alias("first"), "last", "hits")


def fresh_captions(captions: DataFrame, late: str = "7 days", time: str = "_at") -> DataFrame:
    """Captions of clip versions (clip and content hash) that were not seen before: on a stream inside
    the watermark, on a table at all."""
    seen = ["clip_id", "hash", "seq"]
    return captions.withWatermark(time, late).dropDuplicatesWithinWatermark(seen) if captions.isStreaming else captions.dropDuplicates(seen)


def caption_checks(
    captions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, late: str = "7 days", arrived: Column | None = None,
) -> StreamingQuery:
    """Run the caption gate on arriving caption files. A clip version (clip and content hash) that
    was already seen inside the watermark is skipped; each batch goes through the batch operator."""
    stamp = F.current_timestamp() if arrived is None else arrived
    fresh = fresh_captions(captions.withColumn("_at", stamp), late)

    def work(batch: DataFrame, number: int) -> None:
        sink(caption_qc(batch.drop("_at")), number)

    return fresh.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_folder(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop; the checkpoint carries state to the next run."""
    return (
        df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
