"""Greedy left-to-right grouping of an ordered relation, exact and parallel inside one entity.

A greedy rule ("start a block, extend it while it fits, start the next one") is sequential, but
the place and manner of a start decide the next start. So every possible start is a *node* with
a rising id, and states, without knowing the true blocks, the node that would follow it. The real
starts are the chain root -> next -> next ... of each entity:

1. inside chunks of ``CHUNK`` ids, every node finds where its chain leaves the chunk, and the chain from the
   chunk's first node is marked: all that an entity of one chunk needs;
2. for longer entities, only landing nodes (few per chunk, because chains coalesce) are linked across chunks;
3. each of their chunks replays its part from its now known entry.

No task holds more than one chunk of nodes (and an Arrow batch), or the landing nodes of one entity. Chunks of many
small entities are solved together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.operators.slices import SLICE_SECONDS, Layout, running
from cuewright.session import written

CHUNK = 1 << 16
NEVER = 1 << 62


def leave_chunk(ids: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """First chain id outside the chunk for each node of it (ids sorted)."""
    return nxt[_last_inside(np.searchsorted(ids, nxt), np.full(len(ids), len(ids)))]


def _last_inside(hop: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the chain of each node was last, before it went past ``end`` of its group."""
    hop = np.where(hop < end, hop, np.arange(len(hop)))
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            return hop
        hop = further


def _fields(df: DataFrame, key: Sequence[str], *names: str) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in key], *[T.StructField(n, T.LongType()) for n in names]])


def _known(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key has no null part."""
    return df.dropna(subset=list(key))


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls and NaNs are equal to their like."""
    a, b = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def by_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: T.StructType) -> DataFrame:
    """``work(table, bounds)`` over whole groups of ``df``, many small ones in one call.

    Groups come one after the other, in ``order`` inside; group i is rows ``bounds[i]`` to ``bounds[i + 1]`` of
    the table. A call costs the same for one group as for thousands, and a task holds an Arrow batch and at
    most one group besides.
    """
    group = list(group)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            out = work(table, np.r_[0, starts, table.num_rows])
            if out is not None and out.num_rows:
                yield from out.select(arrow.names).cast(arrow).to_batches(max_chunksize=10_000)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            joint = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]).select(group)
            new = np.zeros(joint.num_rows - 1, bool)
            for column in joint.columns:
                new |= _differs(column)
            starts = np.flatnonzero(new) + (size if held else 1)
            if len(starts):
                cut = int(starts[-1])  # the last group may go on in the next batch
                yield from done([*held, batch.slice(0, cut - size)], starts[:-1])
                held, size = [batch.slice(cut - size)], size + batch.num_rows - cut
            else:
                held, size = [*held, batch], size + batch.num_rows
        if held:
            yield from done(held, np.array([], np.int64))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def _hops(group: np.ndarray, local: np.ndarray, nxt: np.ndarray, chunk: int) -> np.ndarray:
    """Row of the first node at or past ``nxt`` in the same group, or that of the next group."""
    wide = chunk + 1
    if wide * (int(group[-1]) + 1) < 1 << 62:
        return np.searchsorted(group * wide + local, group * wide + np.minimum(nxt, chunk))
    first = np.searchsorted(group, np.arange(int(group[-1]) + 2))
    return np.concatenate([a + np.searchsorted(local[a:b], nxt[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])


def _solve(ids: np.ndarray, nxt: np.ndarray, base: np.ndarray, bounds: np.ndarray, chunk: int, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain of each node leaves its group, and whether it is on the chain from the group's first node
    (or from the first one at or past ``entry``). ``base``: the id at which the chunk of each row begins."""
    counts = np.diff(bounds)
    group, end = np.repeat(np.arange(len(counts)), counts), np.repeat(bounds[1:], counts)
    hop = _hops(group, ids - base, nxt - base, chunk)
    out = nxt[_last_inside(hop, end)]
    hit, step = np.zeros(len(ids), bool), hop.tolist()
    for k, (at, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if entry is not None:
            at += int(np.searchsorted(ids[at:stop], entry[k]))
        while at < stop:
            hit[at] = True
            at = step[at]
    return out, hit


def _link(table: pa.Table, bounds: np.ndarray, key: Sequence[str], chunk: int) -> pa.Table:
    """Nodes of whole chunks with where their chain leaves the chunk (``out``), whether they are on the chain from
    its first node (``hit``), and whether they are that node (``head``)."""
    ids, nxt, number = (table[c].to_numpy() for c in ("id", "nxt", "_chunk"))
    out, hit = _solve(ids, nxt, number * chunk, bounds, chunk)
    head = np.zeros(len(ids), bool)
    head[bounds[:-1]] = True
    return table.append_column("out", pa.array(out)).append_column("hit", pa.array(hit)).append_column("head", pa.array(head))


def _linked_schema(df: DataFrame, key: Sequence[str]) -> T.StructType:
    fields = _fields(df, key, "_chunk", "id", "nxt", "out")
    return T.StructType([*fields, T.StructField("hit", T.BooleanType()), T.StructField("head", T.BooleanType())])


def chain(nodes: DataFrame, key: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Nodes ``(key, id)`` on the chain from the smallest id of each entity, given
    ``nodes(key, id, nxt)`` with ``nxt > id``; an id past the last one ends the chain. Entities with a null in their
    key have no chain."""
    key = list(key)
    sliced = _known(nodes, key).select(
        *key, F.floor(F.col("id") / chunk).cast("bigint").alias("_chunk"), F.col("id").cast("bigint"), F.col("nxt").cast("bigint")
    )
    linked = by_groups(sliced, [*key, "_chunk"], ["id"], lambda t, b: _link(t, b, key, chunk), _linked_schema(nodes, key))
    return _chained(written(linked), key, chunk)


def _chained(linked: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """The chain of each entity, from the nodes of its chunks as ``_link`` leaves them."""
    low, high = linked.agg(F.min("_chunk"), F.max("_chunk")).first()
    if low == high:  # no entity has two chunks
        return linked.filter("hit").select(*key, "id")
    heads = linked.filter("head")
    ends = heads.groupBy(*key).agg(F.min("id").alias("_root"), F.min("_chunk").alias("_c0"), F.max("_chunk").alias("_c1"))
    spanning = written(ends.filter("_c1 > _c0"))
    whole = linked.filter("hit").join(spanning.select(*key), key, "left_anti").select(*key, "id")
    cut = linked.select(*key, "_chunk", "id", "nxt", "out").join(spanning.select(*key), key, "left_semi")
    exits = cut.select(*key, "id", "out")
    roots = spanning.select(*key, F.col("_root").alias("id"))
    landings = exits.select(*key, F.col("out").alias("id")).unionByName(roots).distinct()
    hops = exits.join(landings, [*key, "id"], "left_semi")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        step = dict(zip(group["id"], group["out"], strict=True))
        at, seen = int(group["id"].min()), []
        while at in step:
            seen.append(at)
            at = int(step[at])
        return pd.DataFrame({**{k: group[k].iloc[0] for k in key}, "_entry": seen})

    entries = hops.groupBy(*key).applyInPandas(walk, _fields(linked, key, "_entry"))
    entered = cut.drop("out").join(entries.withColumn("_chunk", F.floor(F.col("_entry") / chunk)), [*key, "_chunk"])

    def replay(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids, nxt, number, entry = (table[c].to_numpy() for c in ("id", "nxt", "_chunk", "_entry"))
        _, hit = _solve(ids, nxt, number * chunk, bounds, chunk, entry[bounds[:-1]])
        return table.filter(pa.array(hit))

    return whole.unionByName(by_groups(entered, [*key, "_chunk"], ["id"], replay, _fields(linked, key, "id")))


def blocks(df: DataFrame, starts: DataFrame, key: Sequence[str], name: str = "block", chunk: int = CHUNK) -> DataFrame:
    """Number the blocks of ``df(key, pos)`` that begin at the rows of ``starts(key, pos)``, from 0."""
    # A start goes before its row in the window, so rows meet the starts without a join.
    marks = starts.select(*key, F.col("pos").cast(df.schema["pos"].dataType).alias("pos"), F.lit(1).alias("_start"))
    both = df.unionByName(marks, allowMissingColumns=True).withColumn("_row", F.col("_start").isNull())
    counted = running(both, Layout(tuple(key), ("pos", "_row"), chunk), {name: ("count", "_start")})
    return counted.filter("_row").select(*df.columns, (F.col(name) - 1).alias(name))


def by_rule(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    rule: Callable[[list[list], int, int, bool], list[tuple[int, int]]],
    reach: int,
    chunk: int = CHUNK,
    grow: bool = False,
    base: int = 1,
) -> DataFrame:
    """The chain ``(key, id)`` of the nodes that a Python rule gives over ``df(key, pos, columns)``.

    ``rule(data, i, first, n)`` returns (id, next id) pairs for row ``i``, with ``base`` ids to a position, rising;
    ``first`` is the position of row 0 of ``data``. A block never holds more than ``reach`` rows, and chunks are
    read with that many rows on both sides, so each rule call sees all it needs. With ``grow``, ids are
    positions and blocks of any length are right: a chunk where a block runs to the end of the margin is
    read again with four times the margin. The nodes of a chunk are linked where they are found and not moved.
    """
    key = list(key)
    df = _known(df, key)
    done, rest = [], df
    while True:
        found = written(_by_rule(rest, key, columns, rule, reach, chunk, grow, base))
        open_ = found.filter("nxt = -1").select(*key, "_chunk").distinct()
        if not grow or open_.isEmpty():
            return _chained(reduce(DataFrame.unionByName, [*done, found]), key, chunk * base)
        open_ = written(open_)
        done.append(found.join(open_, [*key, "_chunk"], "left_anti"))
        reach *= 4
        rest = _read_again(df, open_, key, chunk, reach)


def _read_again(df: DataFrame, chunks: DataFrame, key: list[str], chunk: int, reach: int) -> DataFrame:
    """Rows of ``df`` with ``_only``, the one of ``chunks`` for which each is read (with its margin)."""
    low, high = F.floor(F.greatest(F.col("pos") - reach, F.lit(0)) / chunk), F.floor((F.col("pos") + reach) / chunk)
    near = df.withColumn("_only", F.explode(F.sequence(low, high)))
    return near.join(chunks.withColumnRenamed("_chunk", "_only"), [*key, "_only"], "left_semi")


def _by_rule(df: DataFrame, key: list[str], columns: Sequence[str], rule: Callable, reach: int, chunk: int, grow: bool, base: int) -> DataFrame:
    at = F.col("pos")
    low = F.floor(F.greatest(at - reach, F.lit(0)) / chunk)
    if "_only" in df.columns:
        spread = df.select(*key, "pos", *columns, F.col("_only").alias("_chunk"))
    else:
        spread = df.select(*key, "pos", *columns).withColumn(
            "_chunk", F.explode(F.sequence(low, F.floor((at + reach) / chunk)))
        )

    def step(table: pa.Table, bounds: np.ndarray) -> pa.Table | None:
        data, at = [table[c].to_pylist() for c in columns], table["pos"].to_numpy()
        number = table["_chunk"].to_numpy()
        ids, nxt, sizes, of = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            pos, mine, before = at[a:b], int(number[a]), len(ids)
            part, first = [c[a:b] for c in data], int(pos[0])
            for i in np.flatnonzero(pos // chunk == mine).tolist():
                for x, y in rule(part, i, first, b - a):
                    ids.append(x)
                    nxt.append(y)
            if len(ids) == before:  # a chunk that only holds its neighbour's margin
                continue
            if grow and pos[-1] >= (mine + 1) * chunk - 1 + reach:  # rows may follow the margin
                nxt[before:] = [n if n <= pos[-1] else -1 for n in nxt[before:]]
            sizes.append(len(ids) - before)
            of.append(a)
        if not ids:
            return None
        ids, nxt, sizes = np.array(ids, np.int64), np.array(nxt, np.int64), np.array(sizes)
        rows = np.repeat(of, sizes)
        order = np.lexsort((ids, rows))
        named = table.select([*key, "_chunk"]).take(pa.array(rows))
        named = named.append_column("id", pa.array(ids[order])).append_column("nxt", pa.array(nxt[order]))
        if (nxt < 0).any():  # chunks that are read again: links of the others stay right
            nxt_, bad = nxt[order], np.isin(rows, rows[order][nxt[order] < 0])
            parts = [_link(named.filter(pa.array(~bad)), np.r_[0, np.cumsum(sizes[~np.isin(of, rows[bad])])], key, chunk * base)] if (~bad).any() else []
            lost = named.filter(pa.array(bad))
            n = lost.num_rows
            lost = lost.set_column(lost.schema.get_field_index("nxt"), "nxt", pa.array(nxt_[bad]))
            for c, v in (("out", pa.array(np.zeros(n, np.int64))), ("hit", pa.array(np.zeros(n, bool))), ("head", pa.array(np.zeros(n, bool)))):
                lost = lost.append_column(c, v)
            return pa.concat_tables([*parts, lost])
        return _link(named, np.r_[0, np.cumsum(sizes)], key, chunk * base)

    return by_groups(spread, [*key, "_chunk"], ["pos"], step, _linked_schema(df, key))


def following(
    df: DataFrame, key: Sequence[str], order: str, target: Column, strict: bool = False, hits: Column | None = None,
    width: float = SLICE_SECONDS,
) -> DataFrame:
    """Nodes ``(key, id, nxt)`` where ``nxt`` is the first position with ``order`` at (or strictly
    past) ``target`` of this row; only rows passing ``hits`` count. ``order`` rises along ``pos``."""
    rows = df.select(
        *key, F.col("pos").cast("bigint").alias("pos"), F.col(order).cast("double").alias("_at"),
        target.cast("double").alias("_to"), (F.lit(True) if hits is None else hits).alias("_ok"),
    )
    none = F.lit(None).cast("bigint")
    asks = rows.select(*key, F.col("_to").alias("_at"), F.lit(1 if strict else 0).alias("_kind"), F.col("pos").alias("_ask"), none.alias("_hit"))
    marks = rows.filter("_ok").select(*key, "_at", F.lit(0 if strict else 1).alias("_kind"), none.alias("_ask"), F.col("pos").alias("_hit"))
    layout = Layout(tuple(key), ("_at", "_kind", "_hit", "_ask"), width)
    found = running(asks.unionByName(marks), layout, {"nxt": ("first_after", "_hit")})
    return found.filter("_ask is not null").select(
        *key, F.col("_ask").alias("id"), F.greatest(F.coalesce("nxt", F.lit(NEVER)), F.col("_ask") + 1).alias("nxt")
    )
