"""Interval algebra: overlap joins, as-of lookups, merging, complement and time maps.

Intervals carry ``media_id``, ``s`` and ``e`` in seconds. Overlap joins meet in the cells of a time
tree, so one long recording spreads over as many tasks as it has cells and a long interval is not
copied into every short cell; ordered operators run on slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from cuewright.operators.packs import listed, packed, packed_names, unpacked
from cuewright.operators.slices import (
    SLICE_SECONDS,
    Layout,
    islands,
    neighbours,
    position,
    running,
    timed,
)
from cuewright.session import written

BIN_SECONDS = 10.0
#: Cells of the packs of words, the numbers in a block of rows, and the cells (as a power of two) whose points are listed together.
SPAN_SECONDS, BLOCK_ROWS, LIST_BITS = 60.0, 64, 6
#: The time tree: cells of a level are four (2 ** ``FAN_BITS``) times as long as those below; levels 0 to ``TOP``.
FAN_BITS, TOP = 2, 8
#: Times beyond this many seconds share the cell of this one (endless intervals).
FAR = 1e12
TIMED = timed()


def _bin(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(width))


def _bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One copy of each row per time bin it touches."""
    low = _bin(F.col(start), width)
    return df.withColumn("_bin", F.explode(F.sequence(low, F.greatest(low, _bin(F.col(end), width)))))


def prefixed(df: DataFrame, keep: Sequence[str], prefix: str = "b_") -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _near(at: Column) -> Column:
    return F.greatest(F.least(at, F.lit(FAR)), F.lit(-FAR))


def _level(start: Column, end: Column, width: float) -> Column:
    """The lowest level of the time tree whose cells are as long as the interval, which then
    touches two of them at most; null where a time is null."""
    cells = (_near(end) - _near(start)) / F.lit(width)
    up = F.least(F.ceil(F.log2(cells) / FAN_BITS), F.lit(TOP)).cast("int")
    return F.when(start.isNotNull() & end.isNotNull(), F.when(cells <= 1, F.lit(0)).otherwise(up))


def _cell(at: Column, level: Column, width: float) -> Column:
    times = F.call_function("shiftleft", F.lit(1).cast("bigint"), level * FAN_BITS)
    return F.floor(_near(at) / (F.lit(width) * times))


def _hung(df: DataFrame, start: str, end: str, levels: Column, own: str, width: float) -> DataFrame:
    """One copy of each row per cell it touches on the levels that ``levels`` lists for its own."""
    at = F.col("_level")
    low = _cell(F.col(start), at, width)
    return (
        df.withColumn(own, _level(F.col(start), F.col(end), width))
        .withColumn("_level", F.explode(F.element_at(levels, F.col(own) + 1)))
        .withColumn("_cell", F.explode(F.sequence(low, F.greatest(low, _cell(F.col(end), at, width)))))
    )


def interval_join(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str] = ("media_id",),
    min_overlap: float = 0.0,
    bin_s: float = BIN_SECONDS,
    lean: str = "b",
    exact: bool = False,
) -> DataFrame:
    """Pairs that overlap, with the overlap length. Columns of ``b`` come back as ``b_<name>``.

    Both sides hang in a time tree whose lowest cells are ``bin_s`` long. A pair meets on the level
    of the longer of the two, in the cell that holds the later start, so nothing is emitted twice
    and no shuffle on the bare media key is needed. The side named by ``lean`` (the one with fewer
    rows) is hung on every level from its own to the top, at most 2 * (TOP + 1) copies of a row; the
    other one on its own level and on those that the lean side uses, which are one row of at most
    TOP + 1 numbers. With ``exact`` the lean side too is hung on such levels only, for which the other one is read
    once more. Rows with a null time meet nothing; an infinite end is the end of time.
    Estimates of size leave out these copies, so the sides are merged and never broadcast.
    """
    right = prefixed(b, key)
    few, few_s, few_e = (right, "b_s", "b_e") if lean == "b" else (a, "s", "e")
    many, many_s, many_e = (a, "s", "e") if lean == "b" else (right, "b_s", "b_e")
    # On its own level and on those above it that the other side uses.
    by_own = F.array(*[F.expr(f"array_union(array({i}), filter(_u, x -> x > {i}))") for i in range(TOP + 1)])

    def climbing(df: DataFrame, start: str, end: str, other: DataFrame, other_start: str, other_end: str, own: str) -> DataFrame:
        used = other.agg(F.collect_set(_level(F.col(other_start), F.col(other_end), bin_s)).alias("_u"))
        listed = F.broadcast(used.select(by_own.alias("_used")))
        return _hung(df.crossJoin(listed), start, end, F.col("_used"), own, bin_s).drop("_used")

    if exact:
        hung_few = climbing(few, few_s, few_e, many, many_s, many_e, "_few_own")
    else:
        upward = F.array(*[F.sequence(F.lit(i), F.lit(TOP)) for i in range(TOP + 1)])
        hung_few = _hung(few, few_s, few_e, upward, "_few_own", bin_s)
    hung_many = climbing(many, many_s, many_e, few, few_s, few_e, "_own")
    left, other = (hung_many, hung_few) if lean == "b" else (hung_few, hung_many)
    later = F.greatest("s", "b_s")
    overlap = F.least("e", "b_e") - later
    return (
        left.join(other.hint("merge"), [*key, "_level", "_cell"])
        .filter((F.col("s") < F.col("b_e")) & (F.col("e") > F.col("b_s")))
        .filter(F.col("_level") == F.greatest("_own", "_few_own"))
        .filter(F.col("_cell") == _cell(later, F.col("_level"), bin_s))
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") > min_overlap)
        .drop("_level", "_cell", "_own", "_few_own")
    )


def _block(df: DataFrame, c: str) -> Column:
    """The block of rows that are near by column ``c``: ``BLOCK_ROWS`` numbers, or equal values of another kind."""
    return F.floor(F.col(c) / F.lit(BLOCK_ROWS)) if isinstance(df.schema[c].dataType, NumericType) else F.xxhash64(c)


def kept(df: DataFrame, keep: DataFrame, row: Sequence[str], over: float = 0.03, key=("media_id",)) -> DataFrame:
    """Rows whose total overlap with the kept intervals is longer than ``over`` seconds.

    The rows are moved once, in packs of the blocks that ``row[0]`` numbers. Only the stretches that the rows of a block
    span on each cell of the time tree meet the kept intervals, and what a block meets is listed for it.
    """
    ids = list(dict.fromkeys([*key, *row]))
    home, cols = [*key, "_blk"], [c for c in df.columns if c not in key]
    lv = _level(F.col("s"), F.col("e"), SPAN_SECONDS)
    at = [lv.alias("_lv"), _cell(F.col("s"), lv, SPAN_SECONDS).alias("_at")]
    rows = df.filter(reduce(and_, [F.col(c).isNotNull() for c in ids])).withColumn("_blk", _block(df, row[0]))
    # A bit for each number of a block: as many as rows, if each number is there once.
    single = len(row) == 1 and isinstance(df.schema[row[0]].dataType, IntegralType)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(row[0], F.lit(BLOCK_ROWS)).cast("int")) if single else F.lit(0).cast("bigint")
    spans = written(rows.groupBy(*home, *at).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("_n"), F.bit_or(bit).alias("_bits")))
    once = (F.bit_count(F.bit_or("_bits")) == F.sum("_n")) if single else F.lit(False)
    meets = interval_join(spans.filter("_lv is not null").select(*home, "_lv", "_at", "s", "e"), keep.select(*key, "s", "e"), key, bin_s=SPAN_SECONDS, lean="a", exact=True)
    near = meets.groupBy(*home).agg(F.collect_list(F.struct("_lv", "_at", "b_s", "b_e")).alias("_near"))
    near = near.join(spans.groupBy(*home).agg(once.alias("_once")), home)
    met = unpacked(packed(rows, home, cols).join(near.hint("merge"), home), cols).select("*", *at)
    meets = lambda x: (
        (F.col("s") < x["b_e"]) & (F.col("e") > x["b_s"]) & (x["_at"] == F.col("_at")) & (x["_lv"] == F.col("_lv"))
        & (F.least("e", x["b_e"]) > F.greatest("s", x["b_s"]))
    )
    overlap = lambda x: F.least("e", x["b_e"]) - F.greatest("s", x["b_s"])
    add = lambda acc, x: F.when(meets(x), F.coalesce(acc, F.lit(0.0)) + overlap(x)).otherwise(acc)
    summed = met.withColumn("_part", F.aggregate("_near", F.lit(None).cast("double"), add)).drop("_near")
    if not single:
        return _over(summed, F.sum("_part").over(Window.partitionBy(*home, *row)), over).select(*df.columns)
    # Rows of one number count together; only blocks with such rows are sorted.
    several = _over(summed.filter("not _once"), F.sum("_part").over(Window.partitionBy(*home, *row)), over)
    return _over(summed.filter("_once"), F.col("_part"), over).unionByName(several).select(*df.columns)


def _over(df: DataFrame, total: Column, over: float) -> DataFrame:
    return df.withColumn("_kept", F.round(total, 6)).filter(F.col("_kept") > over)


def covered(df: DataFrame, other: DataFrame, row: Sequence[str], name: str = "covered", key=("media_id",)) -> DataFrame:
    """Seconds of each row covered by the other intervals (0 when none)."""
    ids = list(dict.fromkeys([*key, *row]))
    parts = (
        interval_join(df.select(*dict.fromkeys([*ids, "s", "e"])), other.select(*key, "s", "e"), key)
        .groupBy(*ids)
        .agg(F.sum("overlap").alias(name))
    )
    return df.join(parts, ids, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def text_in(
    intervals: DataFrame, words: DataFrame, row: Sequence[str], margin: float = 0.0, key=("media_id",)
) -> DataFrame:
    """Text spoken inside each interval, in word order; empty when nothing overlaps.

    Words of a cell or less travel in packs of a cell. An interval in one cell has its text there; only what is said in
    intervals of several cells, or in several of one name, is gathered. Longer words are joined one by one. The words are
    read twice, where ``text_once`` reads them once and moves each as a row.
    """
    ids = list(dict.fromkeys([*key, *row]))
    rest = [c for c in intervals.columns if c not in ids]
    kinds = {c: words.schema[c].dataType.simpleString() for c in ("seq", "word")}
    hit = f"array<struct<b_seq:{kinds['seq']},b_word:{kinds['word']}>>"
    ground = lambda at: _cell(at, F.lit(0), SPAN_SECONDS)
    up = lambda at: F.call_function("shiftright", at, F.col("_level") * FAN_BITS)
    told = words.select(*key, "seq", "word", "s", "e")
    cells = (_near(F.col("e")) - _near(F.col("s"))) / F.lit(SPAN_SECONDS)  # as in _level
    long = written(told.filter(cells > 1))

    # A row for each name, with its intervals and what long words they meet. The first one tells whether it stands alone.
    span = F.struct((F.col("s") + margin).alias("_s"), (F.col("e") - margin).alias("_e"))
    zones = intervals.groupBy(*ids).agg(F.collect_list(F.struct(F.lit(1).alias("_one"), *rest)).alias("_rows"), F.collect_list(span).alias("_spans"))
    if long.isEmpty():
        zones = zones.withColumn("_long", F.lit(None).cast(hit))
    else:
        each = zones.select(*ids, F.explode("_spans").alias("_z")).select(*ids, F.col("_z._s").alias("s"), F.col("_z._e").alias("e"))
        heard = interval_join(each, long, key).groupBy(*ids).agg(F.collect_list(F.struct("b_seq", "b_word")).alias("_long"))
        zones = zones.join(heard, ids, "left")
    lo, hi = F.col("_s"), F.col("_e")
    low, high = ground(lo), F.greatest(ground(lo), ground(hi))
    level = _level(lo, hi, SPAN_SECONDS)
    placed = zones.select("*", F.get("_spans", F.lit(0)).alias("_z")).select("*", "_z.*").withColumn("_level", level)
    alone = (F.size("_spans") == 1) & F.col("_long").isNull() & (up(low) == up(high)) & F.col("_level").isNotNull()
    zones = written(placed.withColumn("_alone", F.coalesce(alone, F.lit(False))).drop("_z", "_s", "_e", "_level"))

    # The words of a cell, on level 0 and on those of longer intervals. One that reaches into the next cell has a copy there;
    # above, this is needed only where that cell is the first of its own.
    used = F.broadcast(zones.select(F.inline("_spans")).agg(F.collect_set(level).alias("_u")))  # one row
    start, end = ground(F.col("s")), F.greatest(ground(F.col("s")), ground(F.col("e")))
    reach = F.when(cells <= 1, F.sequence(start, end))  # null for others; the outer form works it out once
    homes = told.withColumn("_home", F.explode_outer(reach)).filter("_home is not null").withColumn("_first", F.col("_home") == start)
    parts = ["seq", "word", "s", "e"]
    packs = packed(homes, [*key, "_home", "_first"], parts).crossJoin(used).withColumn("_level", F.explode("_u")).withColumn("_cell", up(F.col("_home")))
    packs = packs.filter(F.col("_first") | (F.col("_cell") != up(F.col("_home") - 1)))
    packs = packs.select(*key, "_level", "_cell", *[F.col(c).alias(f"w{c}") for c in packed_names(packs, parts)]).hint("merge")
    both = lambda w: F.greatest(w["s"], lo)
    inside = F.filter("_w", lambda w: (w["s"] < hi) & (w["e"] > lo) & (F.least(w["e"], hi) > both(w)) & (up(ground(both(w))) == F.col("_cell")))
    found = F.transform(inside, lambda w: F.struct(w["seq"].alias("b_seq"), w["word"].alias("b_word")))

    def met(those: Column) -> DataFrame:
        spots = zones.filter(those).select(*ids, "_rows", "_long", F.explode("_spans").alias("_z")).select(*ids, "_rows", "_long", "_z.*")
        spots = spots.withColumn("_level", level).filter("_level is not null").withColumn("_cell", F.explode(F.sequence(up(low), up(high))))
        # The intervals of a cell are listed, so that a pack is read once for all of them.
        inner = [c for c in spots.columns if c not in (*key, "_level", "_cell")]
        cells = spots.groupBy(*key, "_level", "_cell").agg(F.collect_list(F.struct(*inner)).alias("_all"))
        each = cells.join(packs, [*key, "_level", "_cell"], "left")
        each = each.select(*key, "_level", "_cell", "_all", *[listed(packs, f"w{c}", "ws").alias(c) for c in parts])
        each = each.select(*key, "_level", "_cell", F.arrays_zip(*parts).alias("_w"), F.explode("_all").alias("_z"))
        return each.select(*key, "_level", "_cell", "_w", "_z.*").withColumn("_hits", F.coalesce(found, F.array().cast(hit)))

    def gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
        said = F.flatten(F.collect_list("_hits")).alias("_hits")
        return df.groupBy(*dict.fromkeys([*by, *ids])).agg(F.first("_rows").alias("_rows"), F.first("_long").alias("_long"), said)

    here = gathered(met(F.col("_alone")), [*key, "_level", "_cell"]).drop("_level", "_cell")
    across = gathered(met(~F.col("_alone")), [])
    nowhere = zones.filter(~F.exists("_spans", lambda x: x["_s"].isNotNull() & x["_e"].isNotNull()))
    nowhere = nowhere.select(*ids, "_rows", "_long", F.array().cast(hit).alias("_hits"))
    everything = F.sort_array(F.concat("_hits", F.coalesce("_long", F.array().cast(hit))))
    text = F.array_join(F.transform(everything, lambda w: w["b_word"]), " ")
    named = reduce(and_, [F.col(c).isNotNull() for c in ids])  # a null equals nothing
    rows = here.unionByName(across).unionByName(nowhere)
    rows = rows.select(*ids, F.explode("_rows").alias("_r"), F.when(named, text).otherwise(F.lit("")).alias("text"))
    return rows.select(*ids, *[f"_r.{c}" for c in rest], "text")


def text_once(
    intervals: DataFrame, words: DataFrame, row: Sequence[str], margin: float = 0.0, key=("media_id",)
) -> DataFrame:
    """The same as ``text_in``, for words that take long to work out and few intervals."""
    ids = list(dict.fromkeys([*key, *row]))
    inner = intervals.select(*ids, (F.col("s") + margin).alias("s"), (F.col("e") - margin).alias("e"))
    said = (
        interval_join(inner, words.select(*key, "seq", "s", "e", "word"), key, lean="a")
        .groupBy(*ids)
        .agg(F.sort_array(F.collect_list(F.struct("b_seq", "b_word"))).alias("_said"))
        .select(*ids, F.array_join(F.transform("_said", lambda w: w["b_word"]), " ").alias("text"))
    )
    return intervals.join(said, ids, "left").withColumn("text", F.coalesce("text", F.lit("")))


def point_in(
    df: DataFrame, t: str, intervals: DataFrame, closed: bool = False, how: str = "left_semi",
    key=("media_id",), bin_s: float = BIN_SECONDS,
) -> DataFrame:
    """Points inside an interval (``left_semi``), outside all (``left_anti``), or paired."""
    right = _bins(prefixed(intervals, key), "b_s", "b_e", bin_s)
    end = F.col(t) <= F.col("b_e") if closed else F.col(t) < F.col("b_e")
    left = df.withColumn("_bin", _bin(F.col(t), bin_s))
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*key, "_bin"]]
    cond += [F.col(t) >= F.col("r.b_s"), end]
    out = left.alias("l").join(right.alias("r").hint("merge"), cond, how)  # as in interval_join
    if how in ("left_semi", "left_anti"):
        return out.drop("_bin")
    return out.select("l.*", *[f"r.{c}" for c in right.columns if c not in (*key, "_bin")]).drop("_bin")


def mid_word(boundary: DataFrame, words: DataFrame, margin: float = 0.05, tail: float = 0.0) -> DataFrame:
    """Boundaries inside a spoken word: past its first and before its last ``margin`` seconds,
    with more than ``tail`` seconds of it still to come."""
    core = words.select(
        "media_id", "word", (F.col("s") + margin).alias("s"), (F.col("e") - F.lit(margin)).alias("e"),
        F.col("e").alias("word_end"),
    )
    hits = point_in(boundary, "t", core.filter("s < e"), how="inner").filter(F.col("t") > F.col("b_s"))
    return hits.filter(F.col("b_word_end") - F.col("t") > tail).select(
        *boundary.columns, F.col("b_word").alias("word"), F.col("b_word_end").alias("word_end")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    t: Column | str,
    ref_t: str,
    take: Sequence[str],
    direction: str = "backward",
    tol: float = 0.0,
    name: str = "ref",
    key: Sequence[str] = ("media_id",),
    width: float = SLICE_SECONDS,
) -> DataFrame:
    """Latest reference at or before each row (``backward``, reaching ``tol`` past it) or the
    earliest at or after it (``forward``), as a struct column; null when there is none.

    Both sides are merged in time order and carried over slices, so a hot key is never sorted in
    one task and no pair is ever expanded.
    """
    at = F.col(t) if isinstance(t, str) else t
    back = direction == "backward"
    # The columns stay apart, so that those the caller does not read are not moved.
    mine = 1 if back else 0
    rows = left.withColumn("_at", (at + tol if back else at - tol).cast("double")).withColumn("_kind", F.lit(mine))
    ref_struct = F.struct(*[F.col(c) for c in take])
    refs = right.select(
        *key,
        F.col(ref_t).cast("double").alias("_at"),
        F.lit(1 - mine).alias("_kind"),
        ref_struct.alias(name),
    )
    both = rows.unionByName(refs, allowMissingColumns=True)
    layout = Layout(tuple(key), ("_at", "_kind", name), width)
    filled = running(both, layout, {name: ("last" if back else "first_after", name)})
    return filled.filter(F.col("_kind") == mine).select(*left.columns, name)


def nearest(
    df: DataFrame, t: str, intervals: DataFrame, reach: float, name: str = "near", key=("media_id",)
) -> DataFrame:
    """Interval whose centre is closest to ``t``, null beyond ``reach``; the earlier one on ties."""
    centred = intervals.select(*key, ((F.col("s") + F.col("e")) / 2).alias("mid"), "s", "e")
    take = ("mid", "s", "e")
    both = asof(df, centred, t, "mid", take, "backward", name="_b", key=key)
    both = asof(both, centred, t, "mid", take, "forward", name="_f", key=key)
    back, ahead = F.col(t) - F.col("_b.mid"), F.col("_f.mid") - F.col(t)
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    dist = F.least(back, ahead)
    return both.withColumn(name, F.when(dist <= reach, best)).drop("_b", "_f")


def pause_around(findings: DataFrame, speech: DataFrame, tol: float = 0.02) -> DataFrame:
    """End of the last speech before each finding and start of the next speech after it."""
    prev = asof(findings, speech, "s", "e", ["e"], "backward", tol, name="_p")
    both = asof(prev, speech, "e", "s", ["s"], "forward", tol, name="_n")
    return both.select(
        *findings.columns,
        F.round("_p.e", 2).alias("cut_from"),
        F.round("_n.s", 2).alias("cut_to"),
    )


def merge_gaps(df: DataFrame, gap: float, layout: Layout = TIMED) -> DataFrame:
    """Sessions of intervals closer than ``gap`` to the end reached so far (strictly)."""
    return _merge(df, layout, lambda reach: F.col("s") - reach < gap)


def merge_overlaps(df: DataFrame, touch: float = 0.05, layout: Layout = TIMED) -> DataFrame:
    """Union of intervals that overlap or touch within ``touch`` seconds (inclusive)."""
    return _merge(df, layout, lambda reach: F.col("s") <= reach + touch)


def _merge(df: DataFrame, layout: Layout, joins) -> DataFrame:
    reach = running(df, layout, {"_reach": ("max", "e")}, inclusive=False)
    starts = F.col("_reach").isNull() | ~joins(F.col("_reach"))
    numbered = islands(reach, layout, starts, "_island")
    return (
        numbered.groupBy(*layout.key, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts"))
        .drop("_island")
    )


def offsets(keep: DataFrame, layout: Layout = TIMED) -> DataFrame:
    """Where each kept interval starts in the output."""
    length = F.col("e") - F.col("s")
    out = running(keep, layout, {"off": ("sum", length)}, inclusive=False)
    return out.withColumn("off", F.coalesce("off", F.lit(0.0)))


def complement(cuts: DataFrame, bounds: DataFrame, tiny: float = 0.0, layout: Layout = TIMED) -> DataFrame:
    """What the cuts leave of each recording's bounds ``(lo, hi)``; a null end cuts to the end."""
    key = list(layout.key)
    far = cuts.withColumn("e", F.coalesce("e", F.lit(float("inf"))))
    lo = bounds.select(*key, F.col("lo").alias("s"), F.col("lo").alias("e"))
    hi = bounds.select(*key, F.col("hi").alias("s"), F.col("hi").alias("e"))
    marks = far.select(*key, "s", "e").unionByName(lo).unionByName(hi)
    reach = running(marks, layout, {"_reach": ("max", "e")}, inclusive=False)
    pieces = reach.select(*key, F.col("_reach").alias("s"), F.col("s").alias("e"))
    limited = pieces.join(bounds, key).select(
        *key, F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e")
    )
    return limited.filter(F.round(F.col("e") - F.col("s"), 6) > tiny)


def enforce_gap(df: DataFrame, gap: float, layout: Layout, name: str = "s_fixed") -> DataFrame:
    """Starts pushed forward so that each is at least ``gap`` after the one before it."""
    ranked = position(df, layout, "_i")
    shifted = running(ranked, layout, {"_m": ("max", F.col("s") - F.col("_i") * F.lit(gap))})
    return shifted.withColumn(name, F.col("_m") + F.col("_i") * F.lit(gap)).drop("_i", "_m")


def clip_to_next(df: DataFrame, layout: Layout) -> DataFrame:
    """Ends cut back to the next start."""
    ahead = neighbours(df, layout, lead={"_next": "s"})
    return ahead.withColumn("e", F.least("e", "_next")).drop("_next")


def point_packs(
    points: DataFrame, t: str, cols: Sequence[str], zones: DataFrame, key: Sequence[str] = ("media_id",), bin_s: float = SPAN_SECONDS
) -> DataFrame:
    """Zones ``(s, e)`` with each pack of points that may hold one of theirs: the columns of ``zones``, the packed ``cols``
    of the points and ``_home``, the cell of level 0 that all points of the pack lie in.

    Points are moved once for each level of the time tree that zones use, one level where they are about as long.
    """
    ground = lambda at: _cell(at, F.lit(0), bin_s)
    up = lambda cell: F.call_function("shiftright", cell, F.col("_level") * FAN_BITS)
    level = _level(F.col("s"), F.col("e"), bin_s)
    low = up(ground(F.col("s")))
    hung = zones.withColumn("_level", level).filter("_level is not null").withColumn(
        "_cell", F.explode(F.sequence(low, F.greatest(low, up(ground(F.col("e"))))))
    )
    used = F.broadcast(zones.agg(F.collect_set(level).alias("_u")))  # one row
    homes = points.filter(F.col(t).isNotNull()).withColumn("_home", ground(F.col(t)))
    packs = packed(homes, [*key, "_home"], cols).crossJoin(used).withColumn("_level", F.explode("_u")).drop("_u")
    packs = packs.withColumn("_cell", up(F.col("_home")))
    return hung.join(packs.hint("merge"), [*key, "_level", "_cell"]).drop("_level", "_cell")


def split_at(intervals: DataFrame, points: DataFrame, guard: float, row: Sequence[str]) -> DataFrame:
    """Pieces of each interval between the points that fall inside it, ``guard`` away from its ends.

    The points of an interval are listed for each stretch of 2 ** ``LIST_BITS`` cells of it, so a long interval is not gathered in
    one place; only the first point of each stretch goes on to the one before it.
    """
    ids = list(dict.fromkeys(["media_id", *row]))
    stretch = lambda cell: F.call_function("shiftright", cell, F.lit(LIST_BITS))
    within = lambda at: F.when(at.isNotNull(), stretch(_cell(at, F.lit(0), SPAN_SECONDS)))
    core = intervals.select(*ids, (F.col("s") + guard).alias("s"), (F.col("e") - guard).alias("e")).filter("s < e")
    met = point_packs(points.select("media_id", "t"), "t", ["t"], core)
    inside = F.filter(listed(met, "t"), lambda t: (t > F.col("s")) & (t < F.col("e")))
    inner = met.select(*ids, stretch(F.col("_home")).alias("_at"), inside.alias("_t")).filter(F.size("_t") > 0)
    s, e = F.col("s"), F.col("e")
    one = lambda at, *t: F.struct(within(at).alias("at"), F.array(*t).alias("t"))
    ends = F.when(within(s).eqNullSafe(within(e)), F.array(one(s, s, e))).otherwise(F.array(one(s, s), one(e, e)))
    marks = intervals.select(*ids, F.explode(ends).alias("_m")).select(*ids, F.col("_m.at").alias("_at"), F.col("_m.t").alias("_t"))
    # Structs are equal where both have a null.
    named = marks.unionByName(inner).select(F.struct(*ids, "_at").alias("_id"), "_t")
    lists = named.groupBy("_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("_t"))
    over = Window.partitionBy(*[f"_id.{c}" for c in ids]).orderBy("_id._at")
    heads = lists.select("_id", F.lead(F.get("_t", F.lit(0))).over(over).alias("_next")).filter("_next is not null")
    pieces = F.transform("_t", lambda t, i: F.struct(t.alias("s"), F.when(i < F.size("_t") - 1, F.get("_t", i + 1)).otherwise(F.col("_next")).alias("e")))
    found = lists.join(heads, "_id", "left").select("_id.*", F.explode(pieces).alias("_p"))
    return found.select(*ids, "_p.s", "_p.e").filter("e is not null")


def to_output(df: DataFrame, t: str, keep: DataFrame, name: str = "out_t") -> DataFrame:
    """Source time to output time; a time inside a cut collapses to the splice."""
    placed = asof(df, offsets(keep), t, "s", ["s", "e", "off"], name="_k")
    k = F.col("_k")
    value = k["off"] + F.least(F.col(t), k["e"]) - k["s"]
    return placed.withColumn(name, F.round(F.coalesce(value, F.lit(0.0)), 3)).drop("_k")


def totals(keep: DataFrame, tail_hold: float = 0.0, key=("media_id",)) -> DataFrame:
    """Kept duration, splice count and final length."""
    return keep.groupBy(*key).agg(
        F.sum(F.col("e") - F.col("s")).alias("kept"),
        (F.count("*") - 1).alias("splices"),
        (F.sum(F.col("e") - F.col("s")) + tail_hold).alias("final_s"),
    )


def retime(df: DataFrame, t: str, old: DataFrame, new: DataFrame, name: str = "new_t") -> DataFrame:
    """Output time of one cut list to output time of another. Removed time goes to the nearest
    splice; time past the old end keeps its distance to the end."""
    old_off, new_off = offsets(old), offsets(new)
    ends = totals(old).select("media_id", F.col("kept").alias("_old_end")).join(
        totals(new).select("media_id", F.col("kept").alias("_new_end")), "media_id"
    )
    src = asof(df, old_off, t, "off", ["s", "off"], name="_o").withColumn(
        "_src", F.col("_o.s") + F.col(t) - F.col("_o.off")
    )
    take = ["s", "e", "off"]
    near = asof(src, new_off, "_src", "s", take, "backward", 1e-6, name="_a")
    near = asof(near, new_off, "_src", "s", take, "forward", name="_n")
    a, n, at = F.col("_a"), F.col("_n"), F.col("_src")
    inside = at <= a["e"] + 1e-6
    to_prev, to_next = at - a["e"], n["s"] - at
    gap = F.when(n.isNull() | (to_prev <= to_next), a["off"] + a["e"] - a["s"]).otherwise(n["off"])
    mapped = F.when(inside, a["off"] + at - a["s"]).otherwise(gap)
    out = near.join(ends, "media_id", "left")
    tt = F.col(t)
    value = (
        F.when((tt <= 0) | (tt > F.col("_old_end") + 1.0), tt)
        .when(tt >= F.col("_old_end"), F.round(F.col("_new_end") + tt - F.col("_old_end"), 2))
        .otherwise(F.round(mapped, 2))
    )
    return out.select(*df.columns, value.alias(name))


def nearest_distance(events: DataFrame, others: DataFrame, name: str = "dist", key=("media_id",)) -> DataFrame:
    """Seconds from each event time ``t`` to the closest other event; null when there is none."""
    refs = others.select(*key, F.col("t").alias("at"))
    both = asof(events, refs, "t", "at", ["at"], "backward", name="_b", key=key)
    both = asof(both, refs, "t", "at", ["at"], "forward", name="_f", key=key)
    return both.withColumn(name, F.least(F.col("t") - F.col("_b.at"), F.col("_f.at") - F.col("t"))).drop("_b", "_f")


def unpaired_events(events: DataFrame, partners: DataFrame, tol: float) -> DataFrame:
    """Events with no partner strictly closer than ``tol`` seconds."""
    near = nearest_distance(events, partners, "_d")
    return near.filter(F.col("_d").isNull() | (F.col("_d") >= tol)).drop("_d")


def event_conflicts(events: DataFrame, cuts: DataFrame, low: float = 0.05, high: float = 1.2) -> DataFrame:
    """Events too close to a cut without falling on it."""
    near = nearest_distance(events, cuts)
    return near.filter((F.col("dist") > low) & (F.col("dist") < high))


def voice_without_word(
    speech: DataFrame, words: DataFrame, row: Sequence[str], min_s: float = 0.2, share: float = 0.25
) -> DataFrame:
    """Speech of some length that words hardly cover."""
    length = F.col("e") - F.col("s")
    some = speech.filter(length >= min_s)
    out = covered(some, words, row).withColumn("coverage", F.round(F.col("covered") / length, 6))
    return out.filter(F.col("coverage") < share)
