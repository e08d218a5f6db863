"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, mixing by source, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, table
from cuewright.llm.decontamination import drop_leaks
from cuewright.llm.mixing import mix_documents
from cuewright.llm.quality_rules import keep_documents
from cuewright.llm.sharding import SHARDS, shard_rows
from cuewright.llm.simhash_dedup import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or the record of their host, reject go. Columns stay as they are;
    null and empty texts go; an empty table stays empty."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and epoch that takes words of it, with the words taken.
    Documents without words, or that no draw meets, are not part of it."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, shard and slot; these replace columns of the same names."""
    placed = shard_rows(docs, SHARDS)
    new = ("size", "text_crc32", "shard", "slot")
    return placed.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in new], *new)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hashed fingerprints and permutations have no counterpart in SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
