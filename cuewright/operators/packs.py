"""Runs of neighbouring rows moved as one row.

A word is a few bytes of text, two times and a number; as a row of its own a shuffle moves several times that. ``packed``
turns the rows that follow each other with equal keys into one row with a list per column, ``unpacked`` gives them back.
It works on the Arrow batches that Spark partitions and holds one batch at a time. What is packed is the caller's
rows as they come: rows of one key that lie apart are several packs, nothing is sorted or gathered for it.

Inside a pack, texts are one string between separators (a batch with null texts or texts that hold the separator stays a
list), and whole numbers are kept as what they differ from a run that counts up by one from the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, ShortType, StringType, StructField, StructType

SEPARATOR = "\x1f"
#: Differences of whole numbers within these bounds cannot overflow.
SAFE = 1 << 61


def packed(df: DataFrame, by: Sequence[str], cols: Sequence[str], spans: tuple[str, str] = ("s", "e")) -> DataFrame:
    """One row per run of rows with equal ``by`` columns, with the columns ``cols`` packed; ``spans`` names a start and an end,
    if both are among them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [StructField(c, kinds[c]) for c in by]
    for c in cols:
        fields.append(StructField(f"{c}_l", ArrayType(kinds[c])))
        if kinds[c] == StringType():
            fields.append(StructField(f"{c}_t", StringType()))
        elif kinds[c] == LongType():
            fields.append(StructField(f"{c}_f", LongType()))
        elif c == spans[1] and spans[0] in cols and kinds[c] == kinds[spans[0]] == DoubleType():
            fields.append(StructField(f"{c}_d", ArrayType(ShortType())))
    ends = {c: spans[0] for c in cols if any(f.name == f"{c}_d" for f in fields)}
    texts = {c for c in cols if kinds[c] == StringType()}
    wholes = {c for c in cols if kinds[c] == LongType()}
    return df.select(*dict.fromkeys([*by, *cols])).mapInArrow(_packer(list(by), list(cols), texts, wholes, ends), StructType(fields))


def _lengths(start: pa.Array, end: pa.Array) -> np.ndarray | None:
    """Milliseconds from start to end, if they give back every end."""
    if start.null_count or end.null_count:
        return None
    s, e = start.to_numpy(), end.to_numpy()
    if not (np.abs(s) < 1e12).all() or not (np.abs(e - s) < 32).all():
        return None
    d = np.rint(e * 1000.0) - np.rint(s * 1000.0)
    back = (np.rint(s * 1000.0) + d) / 1000.0
    return d.astype(np.int16) if (back.view(np.int64) == e.view(np.int64)).all() else None


def _packer(by: list[str], cols: list[str], texts: set[str], wholes: set[str], spans: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            breaks = np.zeros(n - 1, dtype=bool)
            for c in by:
                a = batch.column(c)
                # Beside a null a new run begins.
                breaks |= pc.fill_null(pc.not_equal(a.slice(1), a.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(breaks) + 1]).astype(np.int32)
            ends = pa.array(np.concatenate([starts, [n]]).astype(np.int32))
            out = {c: batch.column(c).take(pa.array(starts)) for c in by}
            for c in cols:
                a = batch.column(c)
                rows = pa.ListArray.from_arrays(ends, a)
                if c in texts:
                    plain = a.null_count == 0 and not pc.any(pc.match_substring(a, SEPARATOR)).as_py()
                    none = pa.nulls(len(starts), rows.type if plain else a.type)
                    out |= {f"{c}_l": none, f"{c}_t": pc.binary_join(rows, SEPARATOR)} if plain else {f"{c}_l": rows, f"{c}_t": none}
                elif c in wholes:
                    v = None if a.null_count else a.to_numpy()
                    if v is None or v.min() < -SAFE or v.max() > SAFE:
                        out |= {f"{c}_l": rows, f"{c}_f": pa.nulls(len(starts), a.type)}
                    else:
                        lengths = np.diff(np.append(starts, n))
                        run = np.repeat(v[starts] - starts, lengths) + np.arange(n)
                        out |= {f"{c}_l": pa.ListArray.from_arrays(ends, pa.array(v - run)), f"{c}_f": pa.array(v[starts])}
                elif c in spans:
                    d = _lengths(batch.column(spans[c]), a)
                    none = pa.nulls(len(starts), rows.type if d is not None else pa.list_(pa.int16()))
                    out |= {f"{c}_l": rows, f"{c}_d": none} if d is None else {f"{c}_l": none, f"{c}_d": pa.ListArray.from_arrays(ends, pa.array(d))}
                else:
                    out[f"{c}_l"] = rows
            yield pa.RecordBatch.from_pydict(out)

    return pack


def listed(df: DataFrame, c: str, start: str = "s") -> Column:
    """The values of the packed column ``c`` as an array; ``start`` is the start that an end belongs to."""
    if f"{c}_t" in df.columns:
        return F.coalesce(f"{c}_l", F.split(f"{c}_t", SEPARATOR, -1))
    if f"{c}_f" in df.columns:
        first = F.col(f"{c}_f")
        return F.when(first.isNull(), F.col(f"{c}_l")).otherwise(F.transform(f"{c}_l", lambda x, i: first + i + x))
    if f"{c}_d" in df.columns:
        end = lambda d, i: (F.rint(F.get(f"{start}_l", i) * 1000.0) + d) / 1000.0
        return F.coalesce(f"{c}_l", F.transform(f"{c}_d", end))
    return F.col(f"{c}_l")


def packed_names(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that hold the packed ``cols``."""
    return [x for c in cols for x in (f"{c}_l", f"{c}_t", f"{c}_f", f"{c}_d") if x in df.columns]


def unpacked(df: DataFrame, cols: Sequence[str], start: str = "s") -> DataFrame:
    """The rows of each pack, with the other columns of ``df`` beside each of them."""
    rest = [c for c in df.columns if c not in packed_names(df, cols)]
    names = [F.col(f"_p.{i}").alias(c) for i, c in enumerate(cols)]
    zipped = F.arrays_zip(*[listed(df, c, start).alias(str(i)) for i, c in enumerate(cols)])
    return df.select(*rest, F.explode(zipped).alias("_p")).select(*rest, *names)
