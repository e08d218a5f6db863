"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import numbered, permuted

SHARDS = 24


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    Rows get global numbers in an order that depends on their content alone; a keyed Feistel
    permutation with cycle walking shuffles the numbers, and place p is slot p div ``shards`` of
    shard p mod ``shards``. So shard and slot can be computed for any row number, shard sizes differ
    by one row at most, and a rerun gives the same result.

    Returns ``_doc`` (a struct of all input columns, whatever their names), ``size`` (UTF-8 bytes of
    the text plus 8; a null text has none), ``text_crc32``, ``row_number``, ``shard`` and ``slot``.
    Null ids and texts are rows like any other; repeated rows get different slots; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("_doc"),
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return _placed(rows, shards, seed).select("_doc", "size", "text_crc32", F.col("_rn").alias("row_number"), "shard", "slot")


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``shard_rows``, but with the id alone in place of the whole row, so that no text moves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return _placed(rows, shards, seed).select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("_rn").alias("row_number"), "shard", "slot")


def _placed(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    total = rows.count()
    at = permuted(F.col("_rn"), F.lit(total).cast("long"), F.lit(seed))
    return (
        numbered(rows, [], ["_id", "size", "text_crc32"])
        .withColumn("_at", at)
        .withColumn("shard", F.pmod("_at", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("_at") / shards).cast("long"))
    )
