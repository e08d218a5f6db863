"""Shared parts of the training-data operators: row numbering, permutations, batched text passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401

#: Fixed by the contracts: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder. Unlike a checkpoint it does not hand on the size
    estimates of its plan, which multiply from join to join in a loop until planning itself takes minutes."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none. Every blank is made a space, runs of other
    characters are cut away by counting the places where a word starts."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], measure: str | None = None) -> DataFrame:
    """Adds ``_rn`` (0, 1, ... within ``group``) and, with ``measure``, ``_off`` (sum of the measure
    over earlier rows) in an order that depends on the rows alone.

    Rows are dealt into hashed buckets of about ``ROWS_PER_BUCKET``; only one summary row per bucket
    is accumulated in one place, and each bucket is numbered by itself, so a group that holds a third
    of all rows is still many tasks. ``order`` must start with a column that spreads rows; rows equal
    in all of ``order`` are interchangeable.
    """
    buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int")
    rows = df.withColumn("_bucket", key)
    keys = [*group, "_bucket"]
    sums = [F.count(F.lit(1)).alias("_n"), *([F.sum(measure).alias("_m")] if measure else [])]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(*sums)
    starts = starts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_m0")] if measure else []),
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_rn", F.row_number().over(within).cast("long") - 1)
    if measure:
        rows = rows.withColumn("_off", F.coalesce(F.sum(measure).over(so_far), F.lit(0)).cast("long"))
    same = None
    other = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in starts.columns if c not in keys])
    for i, c in enumerate(keys):
        one = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    rows = rows.join(other, same).withColumn("_rn", F.col("_rn") + F.col("_n0"))
    if measure:
        rows = rows.withColumn("_off", F.col("_off") + F.col("_m0"))
    return rows.drop("_bucket", "_n0", "_m0", *[f"_k{i}" for i in range(len(keys))])


WALK = 64


def permuted(x: Column, n: Column, key: Column, rounds: int = 4) -> Column:
    """Image of ``x`` in 0..n-1 under a keyed permutation of 0..n-1, as one column expression.

    A Feistel network over the grid a x b with a = ceil(sqrt(n)), b = ceil(n / a) permutes 0..a*b-1;
    cycle walking applies it again while the value is not under ``n``. The grid has fewer than ``a``
    cells too many, so a walk of w steps has a chance of about n ** (-w/2), and for n up to
    ``WALK`` squared no walk is longer than a <= ``WALK`` steps; one that did not end raises an error.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(F.ceil(n / a).cast("long"), F.lit(1).cast("long"))

    def once(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        for r in range(rounds):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.concat_ws(":", key, F.lit(str(r)), left.cast("string"))), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.concat_ws(":", key, F.lit(str(r)), right.cast("string"))), a), a)
        return left * b + right

    steps = F.sequence(F.lit(2), F.lit(WALK))
    first = once(x)
    walked = F.when(first < n, first).otherwise(F.aggregate(steps, first, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc))))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def sample_rows(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of ``key``: the same
    rows on every run, found by a filter. Twice the number is the hard bound."""
    parts = 1 << 30
    share = min(1.0, rows / max(1, df.count()))
    if share < 1.0:
        df = df.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(parts)) < int(share * parts))
    return df.limit(2 * rows)


def map_rows(df: DataFrame, inputs: Sequence[str], keep: Sequence[str], schema: str, fn: Callable[[list[list]], list[list]], chunk: int = 256) -> DataFrame:
    """Columns ``keep`` of ``df`` followed by those of ``schema``, which ``fn`` makes for each chunk of
    rows: lists of the input columns in, lists of the output columns out. Batches travel as Arrow."""
    out = df.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    made = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in made]
    n_keep, n_in = len(keep), len(inputs)
    src = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)])
    names = [*keep, *[k for k, _ in kinds]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, chunk):
                part = big.slice(at, chunk)
                made = fn([part.column(n_keep + i).to_pylist() for i in range(n_in)])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(n_keep)], *[pa.array(v, type=t) for v, (_, t) in zip(made, kinds, strict=True)]], names
                )

    return src.mapInArrow(run, f"{fields}, {schema}" if fields else schema)


def dealt(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A written (checkpointed) table with ``_block``, which deals its rows evenly to blocks of about
    ``rows``, and the number of blocks."""
    blocks = max(1, -(-df.count() // rows))
    return df.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), blocks


def meet_blocks(
    rows: DataFrame,
    queries: DataFrame,
    blocks: int,
    schema: str,
    build: Callable[[list[pa.RecordBatch]], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    chunk: int = 1024,
) -> DataFrame:
    """A stated set of queries against every block of rows, both shuffled by block number.

    A task reads the rows of a block (``_block`` under ``blocks``), builds what ``build`` makes of them, and
    answers the queries behind them in the same sorted stream, at most ``chunk`` at a time: it holds one
    block and one chunk, however many rows and queries there are. Blocks without rows answer nothing.
    """
    copies = queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    stream = rows.withColumn("_kind", F.lit(0)).unionByName(copies.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("_block").sortWithinPartitions("_block", "_kind")
    at_block, at_kind = stream.columns.index("_block"), stream.columns.index("_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, built = None, [], None
        for batch in batches:
            block, kind = batch.column(at_block).to_numpy(), batch.column(at_kind).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if block[a] != current:
                    current, parts, built = block[a], [], None
                if kind[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if built is None and parts:
                    built, parts = build(parts), []
                if built is not None:
                    for c in range(a, b, chunk):
                        yield from answer(built, batch.slice(c, min(chunk, b - c)))

    return stream.mapInArrow(run, schema)
