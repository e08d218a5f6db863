"""Ordered operators that never put one whole entity into one task.

A recording, clip or account may hold a third of all rows. ``Window.partitionBy(entity)`` would
sort that entity in one task, so every ordered operator here works on *slices*: an entity is cut
along its order column into ranges of fixed width, each slice is windowed on its own, and a
one-row-per-slice summary carries running state or edge rows across slice borders. The summary
is ``width`` times smaller than the input and is built with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 16
SLICE_SECONDS = 3600.0


@dataclass(frozen=True)
class Layout:
    """How a relation is ordered: entity columns, total order, and the slicing width.

    ``order[0]`` must be numeric; the slice is ``floor(order[0] / width)``.
    """

    key: tuple[str, ...]
    order: tuple[str, ...]
    width: float = SLICE_ROWS

    def slice_of(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.width))

    def with_width(self, width: float) -> Layout:
        return replace(self, width=width)


def frames(key: str = "media_id", order: str = "frame", width: float = SLICE_ROWS) -> Layout:
    return Layout((key,), (order,), width)


def timed(key: str = "media_id", *order: str, width: float = SLICE_SECONDS) -> Layout:
    return Layout((key,), order or ("s", "e"), width)


def _order_struct(layout: Layout) -> Column:
    return F.struct(*[F.col(c) for c in layout.order])


def _with_heads(sliced: DataFrame, layout: Layout, summary: DataFrame) -> DataFrame:
    """The rows of ``sliced`` and, marked by ``_top``, the row of ``summary`` that goes before each
    slice. Both meet in the shuffle of the window that follows, so rows are moved once."""
    heads = summary.withColumn("_top", F.lit(True))
    return sliced.withColumn("_top", F.lit(False)).unionByName(heads, allowMissingColumns=True)


def _inside(layout: Layout, backward: bool = False) -> WindowSpec:
    """A slice after its summary row, in order or from its last row back."""
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in layout.order]
    return Window.partitionBy(*layout.key, "_slice").orderBy(F.col("_top").desc(), *order)


def _carried(name: str, layout: Layout, backward: bool = False) -> Column:
    return F.first(name).over(_inside(layout, backward).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running(
    df: DataFrame,
    layout: Layout,
    outputs: Mapping[str, tuple[str, Column | str]],
    inclusive: bool = True,
) -> DataFrame:
    """Prefix aggregates per entity. ``outputs`` maps a name to (function, column) where the
    function is one of sum, count, max, min, last, first_after.

    ``last`` is the last non-null value at or before the row, ``first_after`` the first non-null
    value at or after it (both exclude the row itself when ``inclusive`` is false).
    """
    order = _order_struct(layout)
    named = {
        name: (fn, F.col(c) if isinstance(c, str) else c) for name, (fn, c) in outputs.items()
    }
    local_aggs = []
    for name, (fn, c) in named.items():
        if fn == "sum":
            agg = F.sum(c)
        elif fn == "count":
            agg = F.count(c)
        elif fn == "max":
            agg = F.max(c)
        elif fn == "min":
            agg = F.min(c)
        elif fn == "last":
            agg = F.max_by(c, F.when(c.isNotNull(), order))
        elif fn == "first_after":
            agg = F.min_by(c, F.when(c.isNotNull(), order))
        else:
            raise ValueError(f"unknown running function {fn}")
        local_aggs.append(agg.alias(f"_l_{name}"))
    sliced = df.withColumn("_slice", layout.slice_of())
    parts = sliced.groupBy(*layout.key, "_slice").agg(*local_aggs)
    over = Window.partitionBy(*layout.key).orderBy("_slice")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    after = over.rowsBetween(1, Window.unboundedFollowing)
    carry = []
    for name, (fn, _) in named.items():
        part = F.col(f"_l_{name}")
        if fn in ("sum", "count"):
            value = F.sum(part).over(before)
        elif fn == "max":
            value = F.max(part).over(before)
        elif fn == "min":
            value = F.min(part).over(before)
        elif fn == "last":
            value = F.last(part, ignorenulls=True).over(before)
        else:
            value = F.first(part, ignorenulls=True).over(after)
        carry.append(value.alias(f"_c_{name}"))
    moved = {n: c for n, (_, c) in outputs.items() if isinstance(c, str) and c in df.columns and c not in layout.key}
    valued = sliced.select("*", *[c.alias(f"_v_{name}") for name, (_, c) in named.items() if name not in moved])
    joined = _with_heads(valued, layout, parts.select(*layout.key, "_slice", *carry))
    end = Window.currentRow if inclusive else -1
    result = []
    for name, (fn, _) in named.items():
        # Read from the last row back: a frame that reaches to the end is gone through anew for each row.
        backward = fn == "first_after"
        so_far = _inside(layout, backward).rowsBetween(Window.unboundedPreceding, end)
        c, prior = F.col(moved.get(name, f"_v_{name}")), _carried(f"_c_{name}", layout, backward)
        if fn == "sum":
            here = F.sum(c).over(so_far)
            value = F.when(here.isNull(), prior).otherwise(here + F.coalesce(prior, prior * 0, F.lit(0)))
        elif fn == "count":
            value = F.count(c).over(so_far) + F.coalesce(prior, F.lit(0))
        elif fn == "max":
            value = F.greatest(F.max(c).over(so_far), prior)
        elif fn == "min":
            value = F.least(F.min(c).over(so_far), prior)
        else:
            value = F.coalesce(F.last(c, ignorenulls=True).over(so_far), prior)
        result.append(value.alias(name))
    keep = [c for c in df.columns if c not in named]
    return joined.select(*keep, "_top", *result).filter(~F.col("_top")).drop("_top")


def position(df: DataFrame, layout: Layout, name: str = "pos") -> DataFrame:
    """Zero-based rank of each row inside its entity."""
    return running(df, layout, {name: ("count", F.lit(1))}, inclusive=True).withColumn(
        name, F.col(name) - 1
    )


def neighbours(
    df: DataFrame,
    layout: Layout,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Previous-row and next-row values per entity (output name -> source column)."""
    lag, lead = dict(lag or {}), dict(lead or {})
    order = _order_struct(layout)
    sliced = df.withColumn("_slice", layout.slice_of())
    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in dict.fromkeys(lag.values())]), order).alias("_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in dict.fromkeys(lead.values())]), order).alias("_head"))
    parts = sliced.groupBy(*layout.key, "_slice").agg(*aggs)
    over = Window.partitionBy(*layout.key).orderBy("_slice")
    edges = []
    if lag:
        edges.append(F.lag("_tail").over(over).alias("_tail"))
    if lead:
        edges.append(F.lead("_head").over(over).alias("_head"))
    joined = _with_heads(sliced, layout, parts.select(*layout.key, "_slice", *edges))
    inside, own = _inside(layout), ~F.col("_top")
    if lag:
        row = F.struct(*[F.col(c) for c in dict.fromkeys(lag.values())])
        joined = joined.withColumn("_prev", F.lag(F.when(own, row).otherwise(F.col("_tail"))).over(inside))
    if lead:
        row = F.struct(*[F.col(c) for c in dict.fromkeys(lead.values())])
        joined = joined.withColumn("_next", F.coalesce(F.lead(row).over(inside), _carried("_head", layout)))
    result = [F.col(f"_prev.{c}").alias(name) for name, c in lag.items()]
    result += [F.col(f"_next.{c}").alias(name) for name, c in lead.items()]
    made = {*lag, *lead}
    return joined.filter(own).select(*[c for c in df.columns if c not in made], *result)


def lags(df: DataFrame, layout: Layout, col: str, n: int, ahead: bool = False) -> DataFrame:
    """Values of the ``n`` rows before each row, as ``lag_1`` .. ``lag_n``, in one pass; ``ahead`` adds
    that of the row after it, as ``lead_1``."""
    sliced = df.withColumn("_slice", layout.slice_of())
    newest = Window.partitionBy(*layout.key, "_slice").orderBy(*[F.col(c).desc() for c in layout.order])
    last = sliced.select(*layout.key, "_slice", *layout.order, F.col(col).alias("_v"))
    last = last.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= n)
    tails = last.groupBy(*layout.key, "_slice").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_k")).alias("k"), "_v"))).alias("_t")
    )
    earlier = Window.partitionBy(*layout.key).orderBy("_slice").rowsBetween(-n, -1)
    before = F.flatten(F.collect_list("_t").over(earlier))
    edges = tails.select(*layout.key, "_slice", before.alias("_b"))
    if ahead:
        start = sliced.groupBy(*layout.key, "_slice").agg(F.min_by(F.struct(F.col(col).alias("v")), _order_struct(layout)).alias("_s"))
        following = F.lead("_s").over(Window.partitionBy(*layout.key).orderBy("_slice")).alias("_a")
        edges = edges.unionByName(start.select(*layout.key, "_slice", following), allowMissingColumns=True)
        edges = edges.groupBy(*layout.key, "_slice").agg(F.max("_b").alias("_b"), F.max_by("_a", F.col("_a").isNotNull()).alias("_a"))
    joined = _with_heads(sliced, layout, edges)
    inside = _inside(layout)
    ranked = joined.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_b", _carried("_b", layout))
    out = []
    for j in range(1, n + 1):
        carried = F.try_element_at("_b", F.least(F.col("_r") - F.lit(j + 1), F.lit(-1)))["_v"]
        value = F.when(F.col("_r") > j, F.lag(col, j).over(inside)).otherwise(carried)
        out.append(value.alias(f"lag_{j}"))
    if ahead:
        row = F.struct(F.col(col).alias("v"))
        out.append(F.coalesce(F.lead(row).over(inside), _carried("_a", layout))["v"].alias("lead_1"))
    return ranked.select(*df.columns, "_top", *out).filter(~F.col("_top")).drop("_top")


def with_halo(df: DataFrame, layout: Layout, before: float, after: float) -> DataFrame:
    """Copy rows near a slice border into the neighbouring slice, so that a window reaching at
    most ``before`` back and ``after`` ahead on ``order[0]`` is complete inside one slice.

    Adds ``_slice`` and ``_own``; compute over ``halo_window`` and keep the rows with ``_own``.
    """
    at, width = F.col(layout.order[0]), F.lit(layout.width)
    own = layout.slice_of()
    low = F.floor((at - F.lit(after)) / width)
    high = F.floor((at + F.lit(before)) / width)
    return df.withColumn("_slice", F.explode(F.sequence(low, high))).withColumn(
        "_own", F.col("_slice") == own
    )


def halo_window(layout: Layout) -> Window:
    return Window.partitionBy(*layout.key, "_slice").orderBy(*layout.order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_slice", "_own")


def islands(df: DataFrame, layout: Layout, starts: Column, name: str = "island") -> DataFrame:
    """Number the stretches that begin at each row where ``starts`` is true."""
    return running(df, layout, {name: ("sum", F.when(starts, 1).otherwise(0).cast("bigint"))})


def top_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows per entity in two steps: inside salted parts, then over the survivors
    (at most ``n * salts`` rows per entity reach one task)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    salted = df.withColumn("_salt", salt)
    first = Window.partitionBy(*key, "_salt").orderBy(*order)
    some = salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
    last = Window.partitionBy(*key).orderBy(*order)
    return (
        some.drop("_salt", "_rn")
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= n)
    )
