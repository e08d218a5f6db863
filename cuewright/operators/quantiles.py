"""Exact interpolated percentiles without gathering a group.

Equal values are counted before the shuffle, and groups of up to ``2 * ACCURACY`` different values are ranked
by these counts. In larger groups a mergeable sketch brackets each percentile, and only the values inside the bracket
are ranked, at most about ``4 / ACCURACY`` of a group's rows. The sketch's error bound makes the bracket certain, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.session import written

ACCURACY = 10_000


def quantiles(
    df: DataFrame, key: Sequence[str], specs: Mapping[str, tuple[Column | str, float]], accuracy: int = ACCURACY
) -> DataFrame:
    """One row per key with a column per spec: name -> (value, share)."""
    key = list(key)
    values = [F.struct(F.lit(n).alias("spec"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for n, (c, _) in specs.items()]
    single = df.select(*key, F.explode(F.array(*values)).alias("m")).select(*key, "m.spec", "m.v").filter("v is not null")
    counted = written(single.groupBy(*key, "spec", "v").agg(F.count("*").alias("_c")))
    sizes = counted.groupBy(*key, "spec").agg(F.count("*").alias("_d")).filter(F.col("_d") > 2 * accuracy)
    large = written(sizes.select(*key).distinct())
    everyone = Window.partitionBy(*key, "spec")
    if large.isEmpty():
        return _picked(counted.withColumn("n", F.sum("_c").over(everyone)), key, specs)
    names = [(k, f"_q_{k}") for k in key]
    right = large.select(*[F.col(k).alias(a) for k, a in names])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(a)) for k, a in names]) if key else F.lit(True)
    small = counted.join(right, cond, "left_anti").withColumn("n", F.sum("_c").over(everyone))
    return _picked(small, key, specs).unionByName(_bracketed(df.join(right, cond, "left_semi"), key, specs, accuracy))


def _bracketed(df: DataFrame, key: list[str], specs: Mapping[str, tuple[Column | str, float]], accuracy: int) -> DataFrame:
    """The same, ranking only the values that a sketch brackets."""
    cols = {n: (F.col(c) if isinstance(c, str) else c).cast("double") for n, (c, _) in specs.items()}
    shares = {n: q for n, (_, q) in specs.items()}
    slack = 2.0 / accuracy
    aggs = []
    for n, c in cols.items():
        ends = [max(0.0, shares[n] - slack), min(1.0, shares[n] + slack)]
        aggs += [F.percentile_approx(c, ends, accuracy).alias(f"_b_{n}"), F.count(c).alias(f"_n_{n}")]
    bounds = df.groupBy(*key).agg(*aggs)
    names = [(k, f"_q_{k}") for k in key]
    right = bounds.select(*[F.col(k).alias(a) for k, a in names], *[c for c in bounds.columns if c not in key])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(a)) for k, a in names]) if key else F.lit(True)
    joined = df.join(right, cond)
    marks = []
    for n, c in cols.items():
        # Small groups are ranked whole; in large ones the bracket also covers the step between
        # ranks out of n and ranks out of n - 1.
        large = F.col(f"_n_{n}") > 2 * accuracy
        low = F.when(large, F.get(f"_b_{n}", F.lit(0))).otherwise(F.lit(float("-inf")))
        high = F.when(large, F.get(f"_b_{n}", F.lit(1))).otherwise(F.lit(float("inf")))
        at = F.when(c >= low, c)
        marks.append(F.when(c <= high, F.struct(F.lit(n).alias("spec"), at.alias("v"), F.col(f"_n_{n}").alias("n"))))
    counted = (
        joined.select(*key, F.explode(F.array_compact(F.array(*marks))).alias("m"))
        .groupBy(*key, "m.spec", "m.v", "m.n")
        .agg(F.count("*").alias("_c"))
    )
    return _picked(counted, key, specs)


def _picked(counted: DataFrame, key: list[str], specs: Mapping[str, tuple[Column | str, float]]) -> DataFrame:
    """Interpolated percentiles from ``counted(key, spec, v, n, _c)``: how often a value (null: those under the
    bracket) occurs among the ``n`` of its group."""
    shares = {n: q for n, (_, q) in specs.items()}
    over = Window.partitionBy(*key, "spec").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("_c").over(over)).filter("v is not null and not isnan(v)")
    share = F.create_map(*[F.lit(x) for n, q in shares.items() for x in (n, float(q))])[F.col("spec")]
    place = share * (F.col("n") - 1)
    base = F.floor(place)
    picked = ranked.groupBy(*key, "spec").agg(
        F.min(F.when(F.col("_cum") >= base + 1, F.col("v"))).alias("_a"),
        F.min(F.when(F.col("_cum") >= base + 2, F.col("v"))).alias("_b"),
        F.max(place - base).alias("_f"),
    )
    value = F.col("_a") + (F.coalesce("_b", "_a") - F.col("_a")) * F.col("_f")
    return picked.groupBy(*key).agg(*[F.max(F.when(F.col("spec") == n, value)).alias(n) for n in specs])
