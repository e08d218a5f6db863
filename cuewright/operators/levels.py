"""Loudness and frame-level operators over ``level(media_id, frame, db)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.slices import Layout, frames, islands, neighbours, position, running

FRAMES = frames()


def runs(
    level: DataFrame,
    pred: Column,
    min_frames: int = 1,
    layout: Layout = FRAMES,
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Unbroken stretches of frames where ``pred`` holds: first frame, end frame (exclusive),
    length, and any extra aggregates."""
    frame = layout.order[0]
    hits = position(level.filter(pred), layout, "_rank")
    extra = [agg.alias(name) for name, agg in (measures or {}).items()]
    return (
        hits.groupBy(*layout.key, (F.col(frame) - F.col("_rank")).alias("_run"))
        .agg(
            F.min(frame).alias("f0"), (F.max(frame) + 1).alias("f1"), F.count("*").alias("frames"), *extra
        )
        .drop("_run")
        .filter(F.col("frames") >= min_frames)
    )


def runs_hysteresis(
    level: DataFrame, hi: Column, lo: Column, min_frames: int = 1, max_gap: int = 0, layout: Layout = FRAMES
) -> DataFrame:
    """Stretches that begin at a frame passing ``hi`` and go on while frames pass ``lo``;
    up to ``max_gap`` failing frames in between are tolerated."""
    frame = layout.order[0]
    low = level.filter(lo | hi).withColumn("_hi", hi)
    near = neighbours(low, layout, lag={"_prev": frame})
    gap = F.col(frame) - F.col("_prev")
    numbered = islands(near, layout, F.col("_prev").isNull() | (gap > max_gap + 1), "_run")
    return (
        numbered.groupBy(*layout.key, "_run")
        .agg(F.min(F.when(F.col("_hi"), F.col(frame))).alias("f0"), (F.max(frame) + 1).alias("f1"))
        .filter(F.col("f0").isNotNull() & (F.col("f1") - F.col("f0") >= min_frames))
        .drop("_run")
    )


def seconds(df: DataFrame, hop_ms: int) -> DataFrame:
    """Frame runs as an interval relation."""
    hop = F.lit(hop_ms / 1000.0)
    return df.withColumn("s", F.round(F.col("f0") * hop, 3)).withColumn("e", F.round(F.col("f1") * hop, 3))
