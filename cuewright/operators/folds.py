"""Left-to-right folds over entities of any length.

A fold opens a run at a row and lets following rows join it or begin the next one, as a state decides
that all earlier rows of the run have shaped. Each entity is cut into chunks of rows. A chunk is
a function from the state that enters it to the state that leaves it; all are evaluated at once for the
empty state, then again only where the state that really enters differs and has changed since. A
run ends soon for most entries, after which both evaluations agree, so one further round is the
rule, and a run over k chunks takes k rounds. Every row is read a constant number of times for each
chunk border its run crosses; a task holds one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.session import written

CHUNK = 1 << 15

Start = Callable[[tuple], tuple]
Meet = Callable[[tuple, tuple], "tuple | None"]


def _pass(rows: DataFrame, key: Sequence[str], columns: Sequence[str], state: T.StructType, start: Start, meet: Meet, closed: bool) -> DataFrame:
    """Runs of each chunk: ``key, _chunk, _n`` (number within the chunk), the state's fields, and ``_open`` for
    the state that leaves it; with ``closed`` also those that end inside. The state that enters is in
    ``_entry`` of the chunk's first row."""
    keys = [rows.schema[k] for k in key]
    schema = T.StructType([*keys, T.StructField("_chunk", T.LongType()), T.StructField("_n", T.LongType()), *state.fields, T.StructField("_open", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    at_row, at_entry, names = len(key) + 2, len(key) + 2 + len(columns), state.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, n, out = None, None, 0, []

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                chunk = values[: len(key) + 1]
                if chunk != current:
                    if current is not None:
                        out.append((*current, n, *held, True))
                    entry = values[at_entry]
                    current, n, held = chunk, 0, None if entry is None else tuple(entry[c] for c in names)
                row = values[at_row:at_entry]
                joined = None if held is None else meet(held, row)
                if held is not None and joined is None:
                    if closed:
                        out.append((*current, n, *held, False))
                    n += 1
                held = start(row) if joined is None else joined
            yield flush(out)
            out = []
        if current is not None:
            yield flush([(*current, n, *held, True)])

    placed = rows.repartition(*key, "_chunk").sortWithinPartitions(*key, "_chunk", "pos")
    return placed.select(*key, "_chunk", "pos", *columns, "_entry").mapInArrow(run, schema)


def fold_runs(rows: DataFrame, key: Sequence[str], columns: Sequence[str], state: T.StructType, start: Start, meet: Meet, chunk: int = CHUNK) -> DataFrame:
    """``key``, ``seq`` (from 0) and final state of every run of ``rows`` (``key``, ``pos`` from 0, ``columns``).

    ``start(row)`` is the state of a run that begins with a row; ``meet(state, row)`` the state after the row
    has joined, or None if it begins a new run. No rows give no runs.
    """
    names = state.fieldNames()
    rows = rows.withColumn("_chunk", F.floor(F.col("pos") / chunk).cast("long"))
    last = written(rows.groupBy(*key).agg(F.max("_chunk").alias("_last")))
    none = F.lit(None).cast(state)
    if not last.filter("_last > 0").limit(1).count():
        out = _pass(rows.withColumn("_entry", none), key, columns, state, start, meet, True)
        return out.select(*key, F.col("_n").alias("seq"), *names)
    long = written(rows.join(last.filter("_last > 0"), list(key)))
    first = F.col("pos") == F.col("_chunk") * chunk

    def following(left: DataFrame) -> DataFrame:
        """The states of ``left`` as entries of the chunks behind."""
        return left.select(*key, (F.col("_chunk") + 1).alias("_chunk"), F.struct(*names).alias("_entry"))

    def left_by(some: DataFrame) -> DataFrame:
        return written(_pass(some.withColumn("_entry", F.when(first, F.col("_entry"))), key, columns, state, start, meet, False))

    left = left_by(long.withColumn("_entry", none))
    changed = left.filter(F.lit(True))
    while True:
        again = left_by(long.join(following(changed), [*key, "_chunk"]))
        before = left.select(*key, "_chunk", F.struct(*names).alias("_before"))
        changed = written(again.join(before, [*key, "_chunk"]).filter(~F.struct(*names).eqNullSafe(F.col("_before"))).drop("_before"))
        if not changed.limit(1).count():
            break
        left = written(left.join(changed.select(*key, "_chunk"), [*key, "_chunk"], "left_anti").unionByName(changed))
    full = rows.join(following(left), [*key, "_chunk"], "left").withColumn("_entry", F.when(first, F.col("_entry")))
    runs = _pass(full, key, columns, state, start, meet, True).join(last, list(key)).filter("not _open or _chunk = _last")
    runs = written(runs)
    so_far = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    before = before.select(*key, "_chunk", F.coalesce(F.sum("_c").over(so_far), F.lit(0)).alias("_before"))
    return runs.join(before, [*key, "_chunk"]).select(*key, (F.col("_n") + F.col("_before")).alias("seq"), *names)
