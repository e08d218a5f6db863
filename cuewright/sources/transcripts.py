"""Readers of subtitles, recogniser output, captions and alignments.

Each reader is a file scan plus a parse step on a text column; the parse steps are public so that
text that is already in a table goes through the same rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.time import to_seconds

# HTML entities found in subtitle exports (fixed values); the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

ASR_SCHEMA = (
    "struct<segments: array<struct<start: double, end: double, text: string, "
    "words: array<struct<word: string, start: double, end: double>>>>>"
)
CAPTION_SCHEMA = (
    "struct<caps: array<struct<t: string, text: string, s: double, e: double, start: double, "
    "end: double, w: array<string>, em: array<boolean>>>>"
)


def whole_files(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per file: ``media_id`` (file stem) and ``content``."""
    raw = spark.read.option("encoding", encoding).text(glob, wholetext=True)
    path = F.input_file_name()
    return raw.select(
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("media_id"), F.col("value").alias("content")
    )


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"\r\n?", "\n")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_srt(df: DataFrame, key: Sequence[str] = ("media_id",), tolerant: bool = False) -> DataFrame:
    """Subtitle text in ``content`` to cues.

    Strict: the time is on the second line and a block has three lines or more. Tolerant: the time
    is on the first line with an arrow, point or comma milliseconds, entities are decoded and
    empty cues are dropped.
    """
    blocks = F.split(_strip(_clean(F.col("content"))), r"\n\s*\n")
    rows = df.select(*key, F.posexplode(blocks).alias("seq", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    if tolerant:
        arrow = F.transform(lines, lambda x, i: F.when(x.contains("-->"), i))
        at = F.array_min(F.array_compact(arrow))
        rows = rows.select(*key, "seq", lines.alias("l"), at.alias("at")).filter("at is not null")
        time = F.get("l", F.col("at"))
    else:
        rows = rows.select(*key, "seq", lines.alias("l"), F.lit(1).alias("at")).filter(F.size("l") >= 3)
        time = F.get("l", F.lit(1))
    body = F.slice("l", F.col("at") + 2, F.size("l"))
    text = F.regexp_replace(F.array_join(body, " "), "<[^>]+>", "")
    if tolerant:
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
    pattern = r"(\S+)\s*-->\s*(\S+)" if tolerant else r"^(\S+) --> (\S+)"
    cues = rows.select(
        *key, F.col("seq").cast("bigint").alias("seq"),
        to_seconds(F.regexp_extract(time, pattern, 1)).alias("s"),
        to_seconds(F.regexp_extract(time, pattern, 2)).alias("e"),
        _strip(text).alias("text"),
    ).filter("s is not null and e is not null")
    return cues.filter("text <> ''") if tolerant else cues


def read_srt(spark: SparkSession, glob: str, tolerant: bool = False) -> DataFrame:
    return parse_srt(whole_files(spark, glob), tolerant=tolerant)


def parse_asr_words(
    df: DataFrame, key: Sequence[str] = ("media_id",), t0: float | None = None, t1: float | None = None
) -> DataFrame:
    """Recogniser JSON in ``content`` to words; ``t0 <= start < t1`` when a window is given."""
    seg = F.from_json("content", ASR_SCHEMA)["segments"]
    tagged = F.flatten(
        F.transform(
            F.coalesce(seg, F.array()),
            lambda g, i: F.transform(
                F.coalesce(g["words"], F.array()),
                lambda w: F.struct(
                    i.alias("seg"), F.trim(w["word"]).alias("word"), w["start"].alias("s"), w["end"].alias("e")
                ),
            ),
        )
    )
    words = df.select(*key, F.posexplode(tagged).alias("seq", "w")).select(
        *key, F.col("seq").cast("bigint").alias("seq"), "w.seg", "w.word", "w.s", "w.e"
    )
    if t0 is not None:
        words = words.filter(F.col("s") >= t0)
    if t1 is not None:
        words = words.filter(F.col("s") < t1)
    return words


def read_asr_words(spark: SparkSession, glob: str, t0: float | None = None, t1: float | None = None) -> DataFrame:
    return parse_asr_words(whole_files(spark, glob), t0=t0, t1=t1)


def parse_segments_tsv(df: DataFrame, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """``start<TAB>end<TAB>text`` lines in ``line``; the text keeps its own tabs."""
    parts = F.split("line", "\t", 3)
    return df.select(
        *key, F.get(parts, F.lit(0)).try_cast("double").alias("s"),
        F.get(parts, F.lit(1)).try_cast("double").alias("e"), F.get(parts, F.lit(2)).alias("text"),
    ).filter("s is not null and e is not null")


def read_segments_tsv(spark: SparkSession, glob: str) -> DataFrame:
    """Segment files line by line, so that large files split over tasks."""
    raw = spark.read.text(glob).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("media_id"),
        F.col("value").alias("line"),
    )
    return parse_segments_tsv(raw)


def parse_captions(df: DataFrame, key: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Caption JSON in ``content``: a list, or an object with ``caps``; both spellings of a
    caption are accepted. Manual line breaks come back as ``lines``."""
    body = F.trim("content")
    wrapped = F.when(body.startswith("["), F.concat(F.lit('{"caps":'), body, F.lit("}"))).otherwise(body)
    caps = F.from_json(wrapped, CAPTION_SCHEMA)["caps"]
    rows = df.select(*key, F.posexplode(caps).alias("seq", "c"))
    text = F.coalesce("c.t", "c.text")
    lines = F.split(text, "\n")
    return rows.select(
        *key, F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("c.s", "c.start").alias("s"), F.coalesce("c.e", "c.end").alias("e"),
        F.when(text.contains("\n"), F.array_join(F.transform(lines, lambda x: F.trim(x)), " ")).otherwise(text).alias("text"),
        F.when(text.contains("\n"), lines).alias("lines"), F.col("c.w").alias("w"), F.col("c.em").alias("em"),
    )


def read_captions(spark: SparkSession, glob: str) -> DataFrame:
    return parse_captions(whole_files(spark, glob).withColumnRenamed("media_id", "clip_id"))


def parse_textgrid(df: DataFrame, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """The ``words`` tier of an alignment grid in ``content``; empty text is a silence."""
    tiers = F.split(_clean(F.col("content")), r"\n\s*item \[\d+\]:")
    tier = F.get(F.filter(tiers, lambda t: t.rlike('name = "words"')), F.lit(0))
    pattern = r'xmin = ([\d.]+)\s*\n\s*xmax = ([\d.]+)\s*\n\s*text = "(.*?)"'
    picks = [F.regexp_extract_all(tier, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(picks, ("a", "b", "c"), strict=True)])
    return (
        df.select(*key, F.posexplode(zipped).alias("seq", "z"))
        .select(
            *key, F.col("seq").cast("bigint").alias("seq"), F.col("z")["a"].cast("double").alias("s"),
            F.col("z")["b"].cast("double").alias("e"), F.trim(F.col("z")["c"]).alias("word"),
        )
        .withColumn("silence", F.col("word") == "")
    )


def read_textgrid(spark: SparkSession, glob: str) -> DataFrame:
    return parse_textgrid(whole_files(spark, glob))
