"""Frame-level operators: cuts and shots, rolling measures, onsets, splices, breaks, faces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.signal import dot, norm2
from cuewright.functions.time import quantise
from cuewright.operators.greedy import NEVER, blocks, by_rule, chain, following
from cuewright.operators.intervals import asof, interval_join, point_in
from cuewright.operators.levels import FRAMES, runs, runs_hysteresis
from cuewright.operators.quantiles import quantiles
from cuewright.operators.salting import attach
from cuewright.operators.slices import (
    Layout,
    drop_halo,
    halo_window,
    islands,
    neighbours,
    position,
    running,
    top_rows,
    with_halo,
)
from cuewright.session import written

PACK = 128


def debounce(df: DataFrame, k: int, layout: Layout = FRAMES) -> DataFrame:
    """Events more than ``k`` frames after the last one that was kept."""
    at, key = layout.order[0], list(layout.key)
    rows = written(position(df, layout, "pos"))
    links = following(rows, key, at, F.col(at) + k, strict=True, width=layout.width)
    kept = chain(links, key).withColumnRenamed("id", "pos")
    return rows.join(kept, [*key, "pos"], "left_semi").drop("pos")


def spaced_events(df: DataFrame, t: str, gap: float, k: int, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """First ``k`` events in time order, each at least ``gap`` after the last one taken."""
    rows = position(df, Layout(tuple(key), (t,), 3600.0), "pos")
    links = following(rows, key, t, F.col(t) + gap)
    kept = chain(links, key).withColumnRenamed("id", "pos")
    taken = rows.join(kept, [*key, "pos"], "left_semi")
    return position(taken.drop("pos"), Layout(tuple(key), (t,), 3600.0), "pick").filter(F.col("pick") < k)


def dedup_onsets(df: DataFrame, k: int, layout: Layout = FRAMES) -> DataFrame:
    """Events more than ``k`` frames after the previous event, kept or not."""
    at = layout.order[0]
    near = neighbours(df, layout, lag={"_p": at})
    return near.filter(F.col("_p").isNull() | (F.col(at) - F.col("_p") > k)).drop("_p")


def shots(diff: DataFrame, threshold: float = 35.0, k: int = 3) -> DataFrame:
    """Camera shots ``(media_id, f0, f1)`` between debounced cut frames."""
    cuts = debounce(diff.filter(F.col("diff") >= threshold).select("media_id", "frame"), k)
    span = diff.groupBy("media_id").agg((F.max("frame") + 1).alias("_end"))
    edges = cuts.filter("frame > 0").unionByName(span.select("media_id", F.lit(0).cast("bigint").alias("frame")))
    near = neighbours(edges, FRAMES, lead={"f1": "frame"})
    return near.join(span, "media_id").select("media_id", F.col("frame").alias("f0"), F.coalesce("f1", "_end").alias("f1"))


def shot_stats(shot: DataFrame, fps: float = 30.0) -> DataFrame:
    """Shots, median shot length and cuts per ten seconds."""
    timed = shot.withColumn("len_s", (F.col("f1") - F.col("f0")) / fps)
    base = timed.groupBy("media_id").agg(F.count("*").alias("shots"), F.sum(F.col("f1") - F.col("f0")).alias("_f"))
    mid = quantiles(timed, ["media_id"], {"median_s": ("len_s", 0.5)})
    rate = (F.col("shots") - 1) / (F.col("_f") / fps) * 10
    return base.join(mid, "media_id").select("media_id", "shots", F.round("median_s", 6).alias("median_s"), F.round(rate, 6).alias("cuts_per_10s"))


def short_shots(shot: DataFrame, fps: float = 30.0, min_s: float = 1.2, margin: float = 0.5) -> DataFrame:
    """Shots shorter than ``min_s`` away from the ends of the clip."""
    span = shot.groupBy("media_id").agg((F.max("f1") / fps).alias("_dur"))
    timed = shot.join(span, "media_id").withColumn("s", F.col("f0") / fps).withColumn("e", F.col("f1") / fps)
    inner = (F.col("s") > margin) & (F.col("e") < F.col("_dur") - margin)
    return timed.filter(inner & (F.round(F.col("e") - F.col("s"), 6) < min_s)).select("media_id", "f0", "f1")


def stray_frames(diff: DataFrame, mix: DataFrame, threshold: float = 35.0, most: int = 4) -> DataFrame:
    """Up to ``most`` frames between two cuts that are not a blend of their neighbours.
    ``mix(media_id, frame, mix)`` is the distance of the piece at ``frame`` to that blend."""
    peaks = diff.filter(F.col("diff") >= threshold).select("media_id", "frame")
    near = neighbours(peaks, FRAMES, lead={"_n": "frame"}).withColumn("frames", F.col("_n") - F.col("frame"))
    tight = near.filter(F.col("frames") <= most)
    blended = mix.filter(F.col("mix") < threshold / 2).select("media_id", "frame")
    return tight.join(blended, ["media_id", "frame"], "left_anti").select("media_id", "frame", "frames")


def cadence_ratio(diff: DataFrame) -> DataFrame:
    """Share of frames that differ from the one before."""
    return diff.groupBy("media_id").agg(F.avg((F.col("diff") > 0).cast("double")).alias("unique_ratio"))


def rolling(df: DataFrame, outputs: dict, before: int, after: int, layout: Layout = FRAMES) -> DataFrame:
    """Aggregates over frames ``-before..after`` around each frame (name -> aggregate column)."""
    wide = with_halo(df, layout, before, after)
    w = halo_window(layout).rangeBetween(-before, after)
    return drop_halo(wide.select("*", *[agg.over(w).alias(n) for n, agg in outputs.items()]))


def rolling_median(df: DataFrame, col: str, half: int, layout: Layout = FRAMES, name: str = "median") -> DataFrame:
    return rolling(df, {name: F.percentile(col, F.lit(0.5))}, half, half, layout)


def moving_avg(df: DataFrame, col: str, n: int, layout: Layout = FRAMES, name: str = "avg") -> DataFrame:
    """Moving average that counts frames beyond the ends as zero."""
    out = rolling(df, {name: F.sum(col)}, n // 2, (n - 1) // 2, layout)
    return out.withColumn(name, F.col(name) / n)


def peaks(level: DataFrame, rise: float, half: int) -> DataFrame:
    """Local maxima at least ``rise`` over the median of the frames around them."""
    wide = with_halo(level, FRAMES, half, half)
    w = halo_window(FRAMES)
    base = F.percentile("db", F.lit(0.5)).over(w.rangeBetween(-half, half - 1))
    flagged = wide.withColumn("base", base).withColumn("_p", F.lag("db").over(w)).withColumn("_n", F.lead("db").over(w))
    top = (F.col("db") >= F.col("_p")) & (F.col("db") >= F.col("_n")) & (F.col("db") - F.col("base") >= rise)
    return drop_halo(flagged.filter(top).drop("_p", "_n"))


def onsets(level: DataFrame, gap: int = 6, quiet: float = -40.0, loud: float = -30.0) -> DataFrame:
    """Frames where sustained voice starts after ``gap`` quiet frames."""
    wide = with_halo(level, FRAMES, gap, 9)
    w = halo_window(FRAMES)
    db = F.col("db")
    still = F.coalesce(F.max("db").over(w.rangeBetween(-gap, -1)) < quiet, F.lit(True))
    steady = F.count_if(db > quiet).over(w.rangeBetween(0, 7)) >= 5
    burst = F.max("db").over(w.rangeBetween(0, 9)) > loud
    return drop_halo(wide.withColumn("_o", (db > quiet) & still & (steady | burst)).filter("_o").drop("_o"))


def word_onset(words: DataFrame, level: DataFrame, hop: float = 0.01, quiet: float = -40.0) -> DataFrame:
    """Real start of each word: an onset close to the recognised start; else, when the word starts
    in silence, the first onset inside it; else the first onset after a long silence inside it."""
    w = words.withColumn("_i0", F.floor(F.col("s") / hop).cast("bigint")).withColumn("_i1", F.floor((F.col("e") + 0.1) / hop).cast("bigint"))
    short = onsets(level, 6, quiet).filter("frame >= 6").select("media_id", F.col("frame").alias("f"))
    long = onsets(level, 25, quiet).select("media_id", F.col("frame").alias("f"))
    span = 1 << 16
    out = asof(w, short, "_i0", "f", ["f"], "backward", name="_b", width=span)
    out = asof(out, short, "_i0", "f", ["f"], "forward", name="_f", width=span)
    out = asof(out, long, F.col("_i0") + 25, "f", ["f"], "forward", name="_l", width=span)
    ahead = rolling(level, {"_m": F.avg("db")}, 0, 7).select("media_id", F.col("frame").alias("_i0"), "_m")
    out = out.join(ahead, ["media_id", "_i0"], "left")
    back, front = F.col("_i0") - F.col("_b.f"), F.col("_f.f") - F.col("_i0")
    close = F.when((back <= 15) & (front.isNull() | (back <= front)), F.col("_b.f")).when(front <= 15, F.col("_f.f"))
    inside = F.when((F.col("_m") < quiet) & (F.col("_f.f") < F.col("_i1")), F.col("_f.f"))
    later = F.when(F.coalesce(F.col("_m") >= quiet, F.lit(True)) & (F.col("_l.f") < F.col("_i1")), F.col("_l.f"))
    frame = F.coalesce(close, inside, later)
    return out.select(*words.columns, F.round(frame * hop, 3).alias("onset"))


def word_offset(words: DataFrame, level: DataFrame, limit: Column, hop: float = 0.01, quiet: float = -40.0, still: int = 15) -> DataFrame:
    """Where speech that goes on past the recognised end really stops: the first ``still`` quiet
    frames, no later than ``limit`` seconds."""
    calm = rolling(level, {"_m": F.max("db")}, 0, still - 1).filter(F.col("_m") < quiet).select("media_id", F.col("frame").alias("f"))
    w = words.withColumn("_i", F.floor(F.col("e") / hop).cast("bigint")).withColumn("_lim", limit)
    out = asof(w, calm, "_i", "f", ["f"], "forward", name="_c", width=1 << 16)
    return out.select(*words.columns, F.least(F.col("_lim"), F.coalesce(F.col("_c.f") * hop, F.col("_lim"))).alias("speech_end"))


def near_frames(df: DataFrame, level: DataFrame, lo: Column, hi: Column, span: int, pack: int = PACK) -> DataFrame:
    """Add ``near``: the frames ``lo..hi`` of the row's recording as (frame, db), in order.
    ``hi - lo`` is never more than ``span``.

    Frames travel in packs of ``pack`` and the ``span`` frames after them, so each row meets one pack, and the
    frames picked for it are moved no further.
    """
    first, last = F.floor((F.col("frame") - span) / pack), F.floor(F.col("frame") / pack)
    packs = level.select("media_id", "frame", "db", F.explode(F.sequence(first, last)).alias("_pack"))
    packs = packs.groupBy("media_id", "_pack").agg(F.array_sort(F.collect_list(F.struct("frame", "db"))).alias("_f"))
    asks = df.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint")).withColumn("_pack", F.floor(F.col("_lo") / pack))
    inside = F.filter("_f", lambda x: x["frame"].between(F.col("_lo"), F.col("_hi")))
    found = asks.join(packs.hint("merge"), ["media_id", "_pack"], "left")  # far larger than estimates make them
    return found.select(*df.columns, F.coalesce(inside, F.array()).alias("near"))


def snap_quietest(boundary: DataFrame, level: DataFrame, row: Sequence[str], win: float = 0.16, hop: float = 0.01) -> DataFrame:
    """Boundary ``t`` moved to the quietest frame within ``win`` seconds."""
    at, reach = F.rint(F.col("t") / hop), int(win / hop + 1e-9)
    near = near_frames(boundary, level, F.greatest(at - reach, F.lit(0)), at + reach, 2 * reach)
    best = F.array_min(F.transform("near", lambda x: F.struct(x["db"], x["frame"])))
    return near.select(*boundary.columns, F.coalesce(F.round(best["frame"] * hop, 3), F.col("t")).alias("snapped"))


def snap_silence(cuts: DataFrame, silence: DataFrame, row: Sequence[str], side: str, reach: float = 0.25, pad: float = 0.12) -> DataFrame:
    """Cut edge ``t`` moved into the closest silence within ``reach``, ``pad`` inside its edge."""
    ids = list(dict.fromkeys(["media_id", *row]))
    zone = cuts.select(*ids, "t", (F.col("t") - reach - 1e-6).alias("s"), (F.col("t") + reach + 1e-6).alias("e"))
    pairs = interval_join(zone, silence.select("media_id", "s", "e"), bin_s=60.0).filter(
        (F.round(F.col("b_s") - reach, 6) <= F.col("t")) & (F.col("t") <= F.round(F.col("b_e") + reach, 6))
    )
    edge = F.least("b_e", F.col("b_s") + pad) if side == "start" else F.greatest("b_s", F.col("b_e") - F.lit(pad))
    spot = F.round(edge, 3)
    best = pairs.groupBy(*ids).agg(F.min_by(spot, F.struct(F.round(F.abs(spot - F.col("t")), 6), "b_s")).alias("_best"))
    return cuts.join(best, ids, "left").select(*cuts.columns, F.coalesce("_best", "t").alias("snapped"))


def place_in_pause(boundary: DataFrame, pauses: DataFrame, row: Sequence[str], kind: str, last: Column | bool = False, reach: float = 0.35) -> DataFrame:
    """Boundary ``t`` placed in the pause that fits its side: an end prefers the pause at or after
    it, a start the pause at or before it. Without a pause in reach it stays, marked in_speech."""
    ids = list(dict.fromkeys(["media_id", *row]))
    t, far = F.col("t"), round(reach + 0.3, 6)
    zone = boundary.select(*ids, "t", (t - far).alias("s"), (t + far).alias("e"))
    pairs = interval_join(zone, pauses.select("media_id", "s", "e"), bin_s=60.0)
    r0, r1 = F.greatest("b_s", F.floor((t - far) * 100) / 100), F.least("b_e", F.floor((t + far) * 100) / 100)
    pairs = pairs.select(*ids, "t", F.round(r0, 3).alias("r0"), F.round(r1, 3).alias("r1"))
    a, b = F.col("r0"), F.col("r1")
    if kind == "end":
        main = (b >= t - 0.02) & (a <= t + reach)
        spare = (b >= t - 0.10) & (b < t)
        rank = F.struct(F.when((a <= t + 0.02) & (b >= t), 0).otherwise(1).alias("p"), F.round(F.abs(a - t), 6).alias("d"), a.alias("r0"), b.alias("r1"))
    else:
        main = (a <= t + 0.02) & (b >= t - reach)
        spare = (a > t) & (a <= t + 0.10)
        rank = F.struct(F.when((a <= t) & (b >= t - 0.02), 0).otherwise(1).alias("p"), F.round(F.abs(b - t), 6).alias("d"), a.alias("r0"), b.alias("r1"))
    best = pairs.groupBy(*ids).agg(F.min(F.when(main, rank)).alias("_m"), F.min(F.when(spare, rank)).alias("_s"))
    out = boundary.join(best, ids, "left").withColumn("_r", F.coalesce("_m", "_s"))
    p0, p1 = F.col("_r.r0"), F.col("_r.r1")
    holds = (p0 <= t) & (t <= p1)
    if kind == "end":
        is_last = last if isinstance(last, Column) else F.lit(last)
        need = F.when(is_last, 0.12).otherwise(0.03) + 0.02
        spot = p0 + F.least(need, (p1 - p0) * 0.6)
        spot = F.when(holds, F.least(F.greatest(t, spot), p1 - 0.02)).otherwise(spot)
    else:
        spot = F.greatest(p0, p1 - 0.04)
        spot = F.when(holds, F.greatest(p0, F.least(t, p1 - 0.02))).otherwise(spot)
    return out.select(
        *boundary.columns, F.round(F.coalesce(spot, t), 3).alias("placed"), F.when(F.col("_r").isNull(), "in_speech").otherwise("pause").alias("place")
    )


def snap_rise(words: DataFrame, level: DataFrame, row: Sequence[str], before: float = 0.10, after: float = 0.08, value: str = "db") -> DataFrame:
    """Word start moved to the frame before the level first rises past 30 % of its local range."""
    i0 = F.greatest(F.lit(1), F.floor((F.col("s") - before) * 100 + 1e-6).cast("bigint"))
    i1 = F.floor((F.col("s") + after) * 100 + 1e-6).cast("bigint")
    base = words.withColumn("_i0", i0).withColumn("_i1", i1)
    near = near_frames(base, level, F.greatest(F.col("_i0") - 30, F.lit(0)), F.col("_i1") + 29, math.ceil((before + after) * 100) + 60)
    wide = F.array_sort(F.transform(F.filter("near", lambda x: x["frame"] < F.col("_i1") + 30), lambda x: x["db"]))
    near = near.withColumn("_v", wide)
    place = (F.size("_v") - 1) * F.lit(0.1)
    k = F.floor(place).cast("int")
    low = F.get("_v", k) + (F.coalesce(F.get("_v", k + 1), F.get("_v", k)) - F.get("_v", k)) * (place - k)
    top = F.array_max(F.transform(F.filter("near", lambda x: (x["frame"] >= F.col("_i0")) & (x["frame"] < F.col("_i1") + 25)), lambda x: x["db"]))
    near = near.withColumn("_thr", low + (top - low) * 0.3).withColumn("_seg", F.filter("near", lambda x: x["frame"].between(F.col("_i0"), F.col("_i1"))))
    rises = F.filter(
        F.transform("_seg", lambda x, i: F.when((i > 0) & (x["db"] >= F.col("_thr")) & (F.get("_seg", i - 1)["db"] < F.col("_thr")), x["frame"])),
        lambda f: f.isNotNull(),
    )
    first = F.get(rises, F.lit(0))
    return near.select(*words.columns, F.coalesce(F.round((first - 1) / 100.0, 3), F.col("s")).alias("rise"))


def suggest_splice(boundary: DataFrame, level: DataFrame, row: Sequence[str], side: str, hop: float = 0.02) -> DataFrame:
    """Suggested splice around ``t``. Out-point: the first short valley after the last voice, or
    just before the next loud speech when that is close. In-point: the start of the first loud
    sustained speech, taken back a little over its attack."""
    t = F.col("t")
    start = F.floor((t - 1.2) / hop + 1e-6)
    near = near_frames(boundary, level, F.greatest(start, F.lit(0)), F.floor((t + 1.2) / hop + 1e-6), math.ceil(2.4 / hop) + 1)
    at = lambda x: x["frame"] * F.lit(hop)
    nth = lambda i, k: F.get("near", i + k)["db"]
    first = lambda arr: F.get(F.filter(arr, lambda v: v.isNotNull()), F.lit(0))
    if side == "out":
        voice = F.array_max(F.transform(F.filter("near", lambda x: (x["db"] > -35) & (at(x) <= t + 0.1 + 1e-6)), at))
        near = near.withColumn("_v", voice)
        valley = first(F.transform("near", lambda x, i: F.when((at(x) > F.col("_v")) & (nth(i, 0) < -35) & (nth(i, 1) < -35), F.round(at(x) + 0.02, 2))))
        near = near.withColumn("_short", F.coalesce(valley, F.round(F.col("_v") + 0.12, 2)))
        loud = first(F.transform("near", lambda x, i: F.when((at(x) > F.col("_short")) & (nth(i, 0) > -20) & (nth(i, 1) > -20) & (nth(i, 2) > -20), F.round(at(x) - 0.05, 2))))
        near = near.withColumn("_long", F.coalesce(loud, "_short"))
        pick = F.when(F.round(F.col("_long") - F.col("_short"), 6) <= 0.3, F.col("_long")).otherwise(F.col("_short"))
        return near.select(*boundary.columns, F.coalesce(pick, t).alias("suggested"))
    begin = first(F.transform("near", lambda x, i: F.when((at(x) >= t - 0.1 - 1e-6) & (nth(i, 0) > -20) & (nth(i, 1) > -20) & (nth(i, 2) > -20), i)))
    near = near.withColumn("_i", begin)
    one = F.coalesce(nth(F.col("_i"), -1) > -27, F.lit(False)) & (F.col("_i") >= 1)
    two = one & F.coalesce(nth(F.col("_i"), -2) > -27, F.lit(False)) & (F.col("_i") >= 2)
    back = F.when(two, 2).when(one, 1).otherwise(0)
    spot = F.get("near", F.col("_i") - back)["frame"] * F.lit(hop)
    return near.select(*boundary.columns, F.coalesce(F.round(spot - 0.02, 2), t).alias("suggested"))


def join_silence(keep: DataFrame, level: DataFrame, hop: float = 0.01, quiet: float = -40.0, over: float = 0.45) -> DataFrame:
    """Silence on both sides of each splice, when it adds up to a dead pause."""
    near = neighbours(keep, Layout(("media_id",), ("s", "e"), 3600.0), lead={"n0": "s", "n1": "e"}).filter("n0 is not null")
    loud = level.filter(F.col("db") >= quiet).select("media_id", F.col("frame").alias("f"))
    edge = near.withColumn("_out", F.rint(F.col("e") / hop)).withColumn("_in", F.rint(F.col("n0") / hop))
    width = 1 << 16
    got = asof(edge, loud, F.col("_out") - 1, "f", ["f"], "backward", name="_a", width=width)
    got = asof(got, loud, "_in", "f", ["f"], "forward", name="_b", width=width)
    tail = F.least(F.col("e") - F.col("s"), (F.col("_out") - 1 - F.coalesce("_a.f", F.lit(-1))) * hop)
    head = F.least(F.col("n1") - F.col("n0"), F.coalesce((F.col("_b.f") - F.col("_in")) * hop, F.lit(float("inf"))))
    return got.select("media_id", "e", "n0", F.round(tail + head, 3).alias("silence")).filter(F.col("silence") > over)


def join_loudness(splices: DataFrame, level: DataFrame, row: Sequence[str], hop: float = 0.01, within: float = 6.0) -> DataFrame:
    """Splices with strong voice on both sides (means of the frames 40-90 ms away within
    ``within`` dB of the recording's speech level)."""
    speech = voice_levels(level).select("media_id", "speech")
    at = F.col("t") / hop
    near = near_frames(splices, level, F.greatest(F.floor(at - 9 + 1e-6), F.lit(0)), F.floor(at + 9 + 1e-6), 19)
    mean = lambda a, b: F.aggregate(
        F.filter("near", lambda x: (x["frame"] >= F.floor(at + a + 1e-6)) & (x["frame"] < F.floor(at + b + 1e-6))),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["s"] + x["db"]).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.try_divide(acc["s"], acc["n"]),
    )
    # The means travel to the speech level, the frames do not.
    sides = near.select(*splices.columns, mean(-9, -4).alias("before"), mean(4, 9).alias("after"))
    both = sides.join(speech, "media_id")
    strong = (F.col("before") > F.col("speech") - within) & (F.col("after") > F.col("speech") - within)
    # Within coalesce no check for nulls is pushed below the join, where it would work out the means once more.
    return both.filter(F.coalesce(strong, F.lit(False))).select(*splices.columns, F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


def voice_levels(level: DataFrame, drop: float = 22.0) -> DataFrame:
    """Speech level of each recording: the median of frames within ``drop`` dB of its 95th
    percentile; and the median of the audible rest."""
    top = quantiles(level, ["media_id"], {"_p95": ("db", 0.95)})
    marked = attach(level, top, ["media_id"], "inner")
    active = F.col("db") > F.col("_p95") - drop
    return quantiles(
        marked, ["media_id"],
        {"speech": (F.when(active, F.col("db")), 0.5), "pause": (F.when(~active & (F.col("db") > -90), F.col("db")), 0.5)},
    )


def voice_music_gap(level: DataFrame, low: float = 8.0, high: float = 28.0) -> DataFrame:
    """How far speech stands over the pauses, and whether that is outside the accepted range."""
    gap = F.col("speech") - F.col("pause")
    flag = F.when(gap < low, "music_loud").when(gap > high, "music_lost").otherwise("ok")
    return voice_levels(level).select("media_id", F.round(gap, 6).alias("gap"), flag.alias("flag"))


def sfx_over_voice(sfx: DataFrame, voice: DataFrame, sfx_db: float = -35.0, voice_db: float = -26.0) -> DataFrame:
    """Frames where an effect sounds over loud speech."""
    loud = voice.filter(F.col("db") > voice_db).select("media_id", "frame", F.col("db").alias("voice_db"))
    return sfx.filter(F.col("db") > sfx_db).join(loud, ["media_id", "frame"])


def segment_p90(segments: DataFrame, level: DataFrame, row: Sequence[str], floor_db: float = -60.0, pack: int = 20, least: int = 8) -> DataFrame:
    """90th percentile of the audible frames of each segment ``(f0, f1)`` and, per piece of
    ``pack`` frames with enough voice, the lowest piece's 90th percentile."""
    ids = list(dict.fromkeys(["media_id", *row]))
    spans = segments.select(*ids, F.col("f0").cast("double").alias("s"), F.col("f1").cast("double").alias("e"))
    ticks = level.filter(F.col("db") > floor_db).select("media_id", F.col("frame").cast("double").alias("s"), (F.col("frame") + 1).cast("double").alias("e"), "db")
    pairs = written(interval_join(spans, ticks, bin_s=256.0, lean="a").select(*ids, F.floor((F.col("b_s") - F.col("s")) / pack).alias("_piece"), F.col("b_db").alias("db")))
    whole = quantiles(pairs, ids, {"p90": ("db", 0.9)})
    small = pairs.groupBy(*ids, "_piece").agg(F.percentile("db", F.lit(0.9)).alias("_p"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    low = small.groupBy(*ids).agg(F.min("_p").alias("lowest_piece"))
    return segments.join(whole, ids, "left").join(low, ids, "left")


def rank_tracks(samples: DataFrame, frames_per_s: int = 25) -> DataFrame:
    """Score of every audio track of a recording and the best one: speech over noise, minus
    clipping, low level, silence and offset. Tracks under one second score -999."""
    key = ["media_id", "track"]
    stats = samples.groupBy(*key).agg(
        F.count("*").alias("_n"), F.avg("clipped").alias("clipping"), F.avg((F.col("db") < -55).cast("double")).alias("silence"),
        F.abs(F.avg("mean")).alias("dc"),
    )
    levels = quantiles(samples, key, {"speech_db": ("db", 0.75), "noise_db": ("db", 0.15)})
    c = F.col
    score = (
        c("speech_db") - c("noise_db") - c("clipping") * 900 - F.greatest(F.lit(0.0), -34 - c("speech_db")) * 0.7
        - c("silence") * 3 - c("dc") * 40
    )
    scored = stats.join(levels, key).withColumn("score", F.when(c("_n") < frames_per_s, -999.0).otherwise(F.round(score, 3)))
    best = scored.groupBy("media_id").agg(F.max_by("track", F.struct("score", -F.col("track"))).alias("best"))
    return scored.join(best, "media_id").select(*key, "score", (c("track") == c("best")).alias("best"))


def dominant_speaker(windows: DataFrame, dim: int) -> DataFrame:
    """Windows with the cosine to the centroid of the recording's largest cluster."""
    size = windows.groupBy("media_id", "cluster").agg(F.count("*").alias("_n"))
    main = size.groupBy("media_id").agg(F.max_by("cluster", F.struct("_n", -F.col("cluster"))).alias("main_cluster"))
    marked = attach(windows, main, ["media_id"], "inner")
    unit = norm2("embedding")
    mine = marked.filter("cluster = main_cluster").withColumn("_u", unit)
    means = mine.groupBy("media_id").agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double") / F.col("_u")).alias(f"_{i}") for i in range(dim)])
    centroid = means.select("media_id", F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("_c"))
    both = attach(marked, centroid, ["media_id"], "inner")
    sim = F.try_divide(dot("embedding", "_c"), norm2("embedding") * norm2("_c"))
    return both.select(*windows.columns, "main_cluster", sim.alias("sim"))


def static_faces(faces: DataFrame, side_ms: int = 5000, least: int = 6, still: float = 1.5, widen_ms: int = 1000) -> DataFrame:
    """Flag samples on a still screen: the face has not moved for a while before or after, plus
    a second around such samples."""
    layout = Layout(("media_id",), ("t_ms",), 3_600_000.0)
    wide = with_halo(faces, layout, side_ms + widen_ms, side_ms + widen_ms)
    w = halo_window(layout)

    def calm(frame):
        return (
            (F.count("*").over(frame) >= least)
            & (F.max("x").over(frame) - F.min("x").over(frame) < still)
            & (F.max("w").over(frame) - F.min("w").over(frame) < still)
        )

    marked = wide.withColumn("_s", calm(w.rangeBetween(-side_ms, 0)) | calm(w.rangeBetween(0, side_ms)))
    spread = F.max(F.col("_s").cast("int")).over(w.rangeBetween(-widen_ms, widen_ms)) == 1
    return drop_halo(marked.withColumn("static", spread).drop("_s"))


def score_faces(faces: DataFrame, min_score: float = 0.8, min_front: float = 0.35) -> DataFrame:
    """Cover pre-score of usable samples: size, capped sharpness and frontality. Samples are
    usable when they move, are large enough, detected with confidence and turned to the camera."""
    key = ["media_id"]
    faces = written(faces)
    moving = F.when(~F.col("static"), F.col("w"))
    stats = quantiles(faces, key, {"_w60": (moving, 0.6), "_s95": ("sharp", 0.95)})
    top = faces.groupBy(*key).agg(F.max("w").alias("_wmax"))
    sure = ~F.col("static") & (F.col("score") > min_score) & (F.col("front") > min_front)
    both = attach(faces.filter(sure), stats.join(top, key), key, "inner")
    pre = F.col("w") / F.col("_wmax") + F.try_divide(F.least("sharp", "_s95") * 0.6, F.col("_s95")) + F.col("front") * 0.5
    return both.filter(F.col("w") >= F.col("_w60")).select(*faces.columns, pre.alias("pre"))


def spaced_topk(df: DataFrame, score: str, t: str, gap: float, k: int, avoid: Sequence[float] = (), key: Sequence[str] = ("media_id",)) -> DataFrame:
    """The ``k`` best-scored rows of each entity that are at least ``gap`` apart and away from the
    ``avoid`` times, taken in score order.

    At most D rows lie within ``gap`` of any row (D is counted), so the picks are among the best
    ``(k - 1) * D + 1``; only those reach the final choice.
    """
    key = list(key)
    pool = df
    for x in avoid:
        pool = pool.filter(F.abs(F.col(t) - x) >= gap)
    cell = F.floor(F.col(t) / gap)
    counts = pool.select(*key, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_g")).groupBy(*key, "_g").agg(F.count("*").alias("_n"))
    dense = counts.groupBy(*key).agg(F.max("_n").alias("_d"))
    limit = dense.agg(F.max("_d")).first()[0] or 0
    best = top_rows(pool, key, [F.col(score).desc(), F.col(t)], (k - 1) * int(limit) + 1)
    best = best.join(dense, key).filter(F.col("rank") <= (k - 1) * F.col("_d") + 1)
    rows = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*df.columns).alias("row")))).alias("_r"))

    def take(acc: Column, x: Column) -> Column:
        free = F.forall(acc, lambda p: F.abs(p[t] - x["row"][t]) >= gap)
        return F.when((F.size(acc) < k) & free, F.array_append(acc, x["row"])).otherwise(acc)

    empty = F.filter(F.transform("_r", lambda x: x["row"]), lambda _: F.lit(False))
    return rows.select(F.posexplode(F.aggregate("_r", empty, take)).alias("pick", "row")).select("row.*", "pick")


def best(df: DataFrame, key: Sequence[str], score: str, tie: str) -> DataFrame:
    """Best row per group; the smaller ``tie`` wins."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(F.col(score), -F.col(tie))).alias("_b")).select("_b.*")


def widest_gap(df: DataFrame, t: str, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """The longest stretch between consecutive times, the first one on ties."""
    near = neighbours(df.select(*key, t), Layout(tuple(key), (t,), 3600.0), lead={"_n": t}).filter("_n is not null")
    width = F.col("_n") - F.col(t)
    pick = F.max_by(F.struct(F.col(t).alias("s"), F.col("_n").alias("e")), F.struct(width, -F.col(t)))
    return near.groupBy(*key).agg(pick.alias("_g")).select(*key, "_g.s", "_g.e")


def face_stats(faces: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Share of samples with a face, and its median size and position."""
    seen = F.col("score") >= min_score
    share = faces.groupBy("media_id").agg(F.avg(seen.cast("double")).alias("present"))
    mid = quantiles(faces, ["media_id"], {"median_w": (F.when(seen, F.col("w")), 0.5), "median_x": (F.when(seen, F.col("x")), 0.5)})
    return share.join(mid, "media_id", "left")


def caption_safe_y(faces: DataFrame, chin: str = "chin", margin: float = 36, half_block: float = 100, lo: float = 1180, hi: float = 1480) -> DataFrame:
    """Line under which captions stay clear of faces: the 90th percentile of the chin plus
    margins, inside fixed bounds; a default where no face was seen."""
    low = quantiles(faces, ["media_id"], {"_p": (chin, 0.9)})
    y = F.floor(F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("_p") + margin + half_block)))
    everyone = faces.select("media_id").distinct().join(low, "media_id", "left")
    return everyone.select("media_id", F.coalesce(y.cast("bigint"), F.lit(int(lo) + 120).cast("bigint")).alias("caption_y"))


def shot_crop(faces: DataFrame, shot: DataFrame, width: float, crop: float, fallback: float = 0.5, step: float = 0.005) -> DataFrame:
    """One horizontal crop per camera shot from the median face position; a shot without faces
    keeps the crop of the shot before it."""
    shot = written(shot)
    spans = shot.select("media_id", "f0", F.col("f0").cast("double").alias("s"), F.col("f1").cast("double").alias("e"))
    hits = point_in(faces.select("media_id", F.col("frame").cast("double").alias("at"), "x"), "at", spans, how="inner", bin_s=256.0)
    mid = quantiles(hits.select("media_id", F.col("b_f0").alias("f0"), "x"), ["media_id", "f0"], {"face_x": ("x", 0.5)})
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("face_x") - crop / 2) / (width - crop)))
    placed = shot.join(mid, ["media_id", "f0"], "left").withColumn("_c", F.round(quantise(raw, step, 0.0, 1.0), 3))
    placed = placed.withColumn("_c", F.when(F.col("face_x").isNotNull(), F.col("_c")))
    held = locf(placed, "_c", Layout(("media_id",), ("f0",)))
    return held.select("media_id", "f0", "f1", F.coalesce("_c", F.lit(fallback)).alias("cropx"))


def locf(df: DataFrame, col: str, layout: Layout) -> DataFrame:
    """Last known value carried forward."""
    return running(df, layout, {col: ("last", col)})


def merge_equal(shot: DataFrame, col: str, layout: Layout) -> DataFrame:
    """Adjacent shots with the same value become one."""
    near = neighbours(shot, layout, lag={"_p": col})
    ids = islands(near, layout, ~F.col(col).eqNullSafe(F.col("_p")) | F.col("_p").isNull(), "_i")
    return ids.groupBy(*layout.key, "_i").agg(F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.first(col).alias(col)).drop("_i")


def camera_ids(diff: DataFrame, keep: DataFrame, threshold: float = 18.0, fps: float = 30.0, settle: float = 0.20) -> DataFrame:
    """Shots inside the kept frames with a running camera number. ``keep(media_id, f0, f1)``. The
    camera changes at a cut inside a keep (not within ``settle`` seconds of the shot start), or
    when the first frame of a keep differs from the last frame of the keep before."""
    key = ["media_id"]
    spans = keep.select("media_id", "f0", "f1", F.col("f0").cast("double").alias("s"), F.col("f1").cast("double").alias("e"))
    inside = point_in(diff.select("media_id", "frame", "diff", F.col("frame").cast("double").alias("at")), "at", spans, how="inner", bin_s=256.0)
    marks = inside.filter((F.col("diff") >= threshold) | (F.col("frame") == F.col("b_f0"))).select(
        "media_id", "frame", F.col("b_f1").alias("end"), (F.col("frame") == F.col("b_f0")).alias("head"), (F.col("diff") >= threshold).alias("cut")
    )
    rows = written(position(written(marks), Layout(("media_id",), ("frame",)), "pos"))
    wait = int(-(-settle * fps // 1))
    cuts = following(rows, key, "frame", F.col("frame") + wait, hits=F.col("cut"), width=1 << 16)
    heads = following(rows, key, "frame", F.col("frame") + 1, hits=F.col("head"), width=1 << 16).withColumnRenamed("nxt", "_h")
    links = cuts.join(heads, [*key, "id"]).select(*key, "id", F.least("nxt", "_h").alias("nxt"))
    picked = written(rows.join(chain(links, key).withColumnRenamed("id", "pos"), [*key, "pos"], "left_semi"))
    # The very first frame has nothing before it to differ from.
    change = (F.col("cut") & (F.col("pos") > 0)).cast("int")
    named = running(picked, Layout(("media_id",), ("frame",)), {"camera": ("sum", change)})
    near = neighbours(named, Layout(("media_id",), ("frame",)), lead={"_n": "frame"})
    return near.select("media_id", F.col("frame").alias("f0"), F.least(F.coalesce("_n", "end"), "end").alias("f1"), F.col("camera").cast("bigint").alias("camera"))


def look_away(faces: DataFrame, turn: str, gaze: str, turn_over: float, gaze_over: float, min_frames: int) -> DataFrame:
    """Stretches where the head or the eyes leave their usual position; one good sample in
    between is tolerated."""
    ref = quantiles(faces, ["media_id"], {"_t": (turn, 0.5), "_g": (gaze, 0.5)})
    both = attach(faces, ref, ["media_id"], "inner")
    dt, dg = F.col(turn) - F.col("_t"), F.coalesce(F.col(gaze) - F.col("_g"), F.lit(0.0))
    away = (F.abs(dt) > turn_over) | (F.abs(dg) > gaze_over)
    return runs_hysteresis(both, away, away, min_frames, max_gap=1)


def pingpong(shot: DataFrame, short_s: float = 2.6, least: int = 4, fps: float = 30.0) -> DataFrame:
    """Runs of short shots that alternate between at most two framing levels.
    ``shot(media_id, f0, f1, level)``."""
    rows = written(position(written(shot), Layout(("media_id",), ("f0",)), "pos")).withColumn("_short", (F.col("f1") - F.col("f0")) / fps < short_s)
    layout = Layout(("media_id",), ("pos",))
    stretch = islands(rows, layout, ~F.col("_short"), "_i").groupBy("media_id", "_i").agg(F.count("*").alias("n"))
    reach = int(stretch.agg(F.max("n")).first()[0] or 1) + 1

    def rule(data, i, first, count):
        short, level = data
        seen, j = {level[i]}, i + 1
        while j < count and short[j] and short[j - 1] and len(seen | {level[j]}) <= 2:
            seen.add(level[j])
            j += 1
        return [(first + i, first + j)]

    starts = by_rule(rows, ["media_id"], ["_short", "level"], rule, reach).withColumnRenamed("id", "pos")
    grouped = blocks(rows, starts, ["media_id"])
    return grouped.groupBy("media_id", "block").agg(F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.count("*").alias("shots")).filter(
        F.col("shots") >= least
    ).drop("block")


def same_level_cuts(shot: DataFrame) -> DataFrame:
    """Cuts with the same framing on both sides."""
    near = neighbours(shot, Layout(("media_id",), ("f0",)), lag={"_p": "level"})
    return near.filter(F.col("level") == F.col("_p")).drop("_p")


def fix_offsets(pieces: DataFrame, key: str = "media_id", far: float = 0.3, short_s: float = 1.5, weak: float = 0.6) -> DataFrame:
    """Pieces whose sync offset strays from their neighbours' median (three on each side) and that
    are short or weakly matched take the neighbours' median offset and most common source."""
    layout = Layout((key,), ("seq",))
    wide = with_halo(position(pieces.drop("pos"), layout, "pos"), Layout((key,), ("pos",)), 3, 3)
    w = halo_window(Layout((key,), ("pos",)))
    around = F.concat(
        F.collect_list(F.struct("offset", "src")).over(w.rangeBetween(-3, -1)), F.collect_list(F.struct("offset", "src")).over(w.rangeBetween(1, 3))
    )
    near = drop_halo(wide.withColumn("_v", around))
    sorted_off = F.array_sort(F.transform("_v", lambda x: x["offset"]))
    near = near.withColumn("_o", sorted_off)
    half = F.floor(F.size("_o") / 2).cast("int")
    mid = F.when(F.size("_o") % 2 == 1, F.get("_o", half)).otherwise((F.get("_o", half - 1) + F.get("_o", half)) / 2)
    common = F.array_max(F.transform("_v", lambda x, i: F.struct(
        F.size(F.filter("_v", lambda y: y["src"] == x["src"])).alias("n"), (-i).alias("i"), x["src"].alias("src")
    )))["src"]
    stray = (F.abs(F.col("offset") - mid) > far) & ((F.col("e") - F.col("s") < short_s) | (F.coalesce("score", F.lit(1.0)) < weak))
    return near.select(
        key, "seq", F.when(stray, mid).otherwise(F.col("offset")).alias("offset"), F.when(stray, common).otherwise(F.col("src")).alias("src"), F.coalesce(stray, F.lit(False)).alias("replaced")
    )


def best_window(rms: DataFrame, n: int) -> DataFrame:
    """Best ``n`` seconds of a music track: established, steady, gently rising, below the loudest
    part. ``rms(media_id, frame, v)`` with one frame per second."""
    peak = quantiles(rms, ["media_id"], {"_p95": ("v", 0.95)}).join(rms.groupBy("media_id").agg(F.count("*").alias("_len")), "media_id")
    half = n // 2
    v = F.col("v")
    wide = with_halo(rms, FRAMES, 0, n)
    w = halo_window(FRAMES)
    out = wide.select(
        "media_id", "frame", "_own", "_slice", F.avg(v).over(w.rangeBetween(0, n - 1)).alias("_m"), F.stddev_pop(v).over(w.rangeBetween(0, n - 1)).alias("_sd"),
        F.avg(v).over(w.rangeBetween(0, half - 1)).alias("_a"), F.avg(v).over(w.rangeBetween(half, n - 1)).alias("_b"),
    )
    both = attach(drop_halo(out), peak, ["media_id"], "inner").filter(F.col("frame") < F.col("_len") - n)
    m, p = F.col("_m"), F.col("_p95")
    steady = 1 - F.least(F.col("_sd") / (m + 1e-9), F.lit(1.0))
    rise = (F.col("_b") - F.col("_a")) / (m + 1e-9)
    rising = 1 - F.least(F.abs(rise - 0.10) / 0.35, F.lit(1.0))
    room = 1 - F.least(F.greatest(m - p * 0.85, F.lit(0.0)) / (p * 0.3), F.lit(1.0))
    scored = both.filter(m >= p * 0.35).withColumn("score", F.round(steady * 0.45 + rising * 0.35 + room * 0.20, 9))
    pick = F.max_by(F.struct("frame", "score"), F.struct("score", -F.col("frame")))
    return scored.groupBy("media_id").agg(pick.alias("_b")).select("media_id", F.col("_b.frame").alias("start"), F.col("_b.score").alias("score"))


def music_breaks(coarse: DataFrame, fine: DataFrame, target: float | None = None, drop: float = 10.0, back: float = 2.0, ratio: int = 5, least: int = 3) -> DataFrame:
    """Pauses of a track (coarse frames ``drop`` dB under its median) and the impact after each:
    the first fine frame back within ``back`` dB. ``ratio`` fine frames make a coarse one; with a
    ``target`` the offset that puts the impact there."""
    mid = quantiles(coarse, ["media_id"], {"_med": ("db", 0.5)})
    quiet = runs(attach(coarse, mid, ["media_id"], "inner"), F.col("db") < F.col("_med") - drop, least)
    loud = attach(fine, mid, ["media_id"], "inner").filter(F.col("db") >= F.col("_med") - back).select("media_id", F.col("frame").alias("hit"))
    found = asof(quiet, loud, F.col("f1") * ratio - 10, "hit", ["hit"], "forward", name="_h", width=1 << 16)
    out = found.select("media_id", "f0", "f1", F.col("_h.hit").alias("hit"))
    if target is None:
        return out
    hop = 0.05
    return out.withColumn("offset", F.round(F.col("hit") * hop - target, 6)).filter(F.col("offset") >= 0)


def series_target(photos: DataFrame, line: float = 123.0, tol: float = 6.0, key: Sequence[str] = ("series",)) -> DataFrame:
    """Colour target of a photo series: the median of the photos with a face, the skin angle held
    within ``tol`` of the skin line."""
    seen = photos.filter("faces > 0")
    mid = quantiles(seen, key, {"skin_angle": ("skin_angle", 0.5), "skin_chroma": ("skin_chroma", 0.5)})
    held = F.least(F.lit(line + tol), F.greatest(F.lit(line - tol), F.col("skin_angle")))
    return mid.select(*key, held.alias("skin_angle"), "skin_chroma")


def photo_flags(photos: DataFrame, target: DataFrame, tol: float = 6.0, chroma_tol: float = 0.02, key: Sequence[str] = ("series",)) -> DataFrame:
    """Photos that leave their series: skin angle or chroma too far from the target."""
    both = photos.join(target.select(*key, F.col("skin_angle").alias("_a"), F.col("skin_chroma").alias("_c")), list(key))
    flags = F.array_compact(F.array(
        F.when(F.abs(F.col("skin_angle") - F.col("_a")) > tol, "skin_angle"),
        F.when(F.abs(F.col("skin_chroma") - F.col("_c")) > chroma_tol, "skin_chroma"),
    ))
    return both.select(*key, "file", F.explode(flags).alias("flag"))


def speech_blocks(silence: DataFrame, lengths: DataFrame, pauses: DataFrame, max_s: float = 1200.0, pad: float = 1.0, least: float = 2.0) -> DataFrame:
    """Speech regions between long silences, cut into blocks of at most ``max_s`` at the last
    short pause in the final fifth, or hard at the limit when there is none."""
    reach = running(silence, Layout(("media_id",), ("s", "e"), 3600.0), {"_r": ("max", F.col("e") - pad)}, inclusive=False)
    begin = F.greatest(F.lit(0.0), F.coalesce("_r", F.lit(0.0)))
    inner = reach.select("media_id", begin.alias("s"), (F.col("s") + pad).alias("e"))
    last = silence.groupBy("media_id").agg(F.max(F.col("e") - pad).alias("_r"))
    tail = lengths.join(last, "media_id", "left").select("media_id", F.greatest(F.lit(0.0), F.coalesce("_r", F.lit(0.0))).alias("s"), F.col("duration").alias("e"))
    regions = written(inner.unionByName(tail).filter("e > s"))
    # Every region start and every pause inside a region is a possible cut; each names the cut
    # that would follow it. Where no pause qualifies a cut at the limit is added as a new node,
    # so the rounds below number as many as the longest pause-free stretch has limits.
    spans = regions.withColumn("r0", F.col("s")).withColumn("r1", F.col("e"))
    marks = written(pauses.select("media_id", F.round((F.col("s") + F.col("e")) / 2, 6).alias("c")))
    # Regions hardly overlap, so in a cell as long as a region a pause meets a few of them, however many there are.
    points = marks.withColumn("s", F.col("c")).withColumn("e", F.col("c"))
    inside = interval_join(points, spans, min_overlap=-1.0)
    key = ["media_id", "r0", "r1"]
    cuts = inside.select("media_id", F.col("b_r0").alias("r0"), F.col("b_r1").alias("r1"), F.col("c").alias("x"))
    fresh = written(spans.select(*key, F.col("s").alias("x")).unionByName(cuts).distinct())
    links = []
    while True:
        open_ = fresh.filter(F.col("r1") - F.col("x") > max_s)
        found = asof(open_, marks, F.col("x") + max_s, "c", ["c"], name="_p")
        good = F.col("_p.c") > F.col("x") + max_s * 0.8
        step = written(found.select(*key, "x", F.when(good, F.col("_p.c")).otherwise(F.round(F.col("x") + max_s, 6)).alias("to"), F.coalesce(good, F.lit(False)).alias("_real")))
        links += [step.select(*key, "x", "to"), fresh.filter(F.col("r1") - F.col("x") <= max_s).select(*key, "x", F.lit(None).cast("double").alias("to"))]
        fresh = written(step.filter("not _real").select(*key, F.col("to").alias("x")).distinct())
        if fresh.isEmpty():
            break
    every = links[0]
    for part in links[1:]:
        every = every.unionByName(part)
    micro = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    nodes = every.distinct().select(*key, micro("x").alias("id"), F.coalesce(micro("to"), F.lit(NEVER)).alias("nxt"))
    hits = written(chain(nodes, key, chunk=int(max_s * 1e6 * 64))).withColumn("s", F.col("id") / 1e6)
    near = neighbours(hits, Layout(tuple(key), ("s",), max_s * 64), lead={"e": "s"})
    out = near.select("media_id", "s", F.coalesce("e", "r1").alias("e"))
    return out.filter(F.col("e") - F.col("s") > least)
