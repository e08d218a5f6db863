"""Text alignment: token diffs, divergence classes, takes, excerpts and word timing repairs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.functions.text import jaccard, norm_strip, tokens, trim_punct
from cuewright.operators.folds import CHUNK as FOLD_CHUNK
from cuewright.operators.folds import fold_runs
from cuewright.operators.intervals import covered, kept, text_in
from cuewright.operators.levels import runs, seconds
from cuewright.operators.slices import Layout, islands, lags, neighbours, position, running
from cuewright.session import written

# Words whose disagreement is noise (fixed values).
NOISE_WORDS = "e é a o as os um uma que de da do na no em né aí ah então se eu ele ela".split()
MARKS = ".,?!…;:"
#: Rows that ``token_diff`` turns into Python objects at once.
DIFF_ROWS = 256
#: So many ids of recordings are sent to every task, if it saves the move of other recordings' rows.
FEW_RECORDINGS = 1_000_000
OPCODES = T.ArrayType(
    T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2")]])
)


def token_diff(pairs: DataFrame, a: str = "a", b: str = "b", autojunk: bool = True) -> DataFrame:
    """Add ``ratio`` and ``ops`` (edit operations over tokens) to rows with two token arrays.

    The similarity is defined by the standard library's matcher, so it runs there, one row at a
    time inside Arrow batches; no rows are grouped for it. Only ``DIFF_ROWS`` rows of a batch are Python objects at once.
    """
    schema = T.StructType([*pairs.schema.fields, T.StructField("ratio", T.DoubleType()), T.StructField("ops", OPCODES)])

    kind, names = to_arrow_schema(T.StructType([schema["ops"]])).field("ops").type, schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DIFF_ROWS):
                part, ratios, ops = batch.slice(at, DIFF_ROWS), [], []
                for x, y in zip(part.column(a), part.column(b), strict=True):
                    m = difflib.SequenceMatcher(None, list(x.as_py()), list(y.as_py()), autojunk=autojunk)
                    ops.append([dict(zip(("tag", "i1", "i2", "j1", "j2"), op, strict=True)) for op in m.get_opcodes()])
                    ratios.append(m.ratio())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ratios, pa.float64()), pa.array(ops, kind)], names=names)

    return pairs.mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def caption_vs_audio(diffs: DataFrame, key: Sequence[str], a: str = "a", b: str = "b", near: float = 0.82) -> DataFrame:
    """Differences between shown and heard text: noise, review or suspect."""
    rows = diffs.select(*key, a, b, F.explode("ops").alias("op")).filter("op.tag <> 'equal'")
    part = lambda c, i, j: F.slice(c, F.col(i) + 1, F.col(j) - F.col(i))
    shown, heard = part(a, "op.i1", "op.i2"), part(b, "op.j1", "op.j2")
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    rows = rows.select(
        *key, F.col("op.tag").alias("tag"), F.array_join(shown, " ").alias("shown"), F.array_join(heard, " ").alias("heard"),
        F.forall(F.concat(shown, heard), lambda w: F.array_contains(noise, w)).alias("_noise"),
    )
    swap = (F.col("tag") == "replace") & (F.col("shown") != "") & (F.col("heard") != "")
    asked = rows.withColumn("_r", F.when(swap & ~F.col("_noise"), string_ratio("shown", "heard")))
    kind = F.when(F.col("_noise"), "noise").when(swap & (F.col("_r") <= near), "suspect").otherwise("review")
    return asked.withColumn("kind", kind).drop("_noise", "_r")


def divergence_summary(diffs: DataFrame, classes: DataFrame, key: Sequence[str], least: float = 0.85) -> DataFrame:
    """Differences and suspects per clip, and whether its similarity blocks it."""
    counts = classes.groupBy(*key).agg(F.count("*").alias("differences"), F.count_if(F.col("kind") == "suspect").alias("suspects"))
    base = diffs.select(*key, F.round("ratio", 4).alias("ratio"))
    out = base.join(counts, list(key), "left").fillna(0, ["differences", "suspects"])
    return out.withColumn("blocked", F.col("ratio") < least)


def edge_actions(ops: Column) -> Column:
    """What a diff says about the first and last caption words: how many to drop, which heard
    tokens (index range) to add."""
    first, last = F.get(ops, F.lit(0)), F.try_element_at(ops, F.lit(-1))

    def side(op: Column, active: Column) -> tuple[Column, Column]:
        shown, heard = op["i2"] - op["i1"], op["j2"] - op["j1"]
        drop = F.when(active & op["tag"].isin("delete", "replace") & (shown <= 2), shown).otherwise(0)
        add = F.when(active & op["tag"].isin("insert", "replace") & (heard <= 3), F.struct(op["j1"].alias("j1"), op["j2"].alias("j2")))
        return F.coalesce(drop, F.lit(0)), add

    d0, a0 = side(first, F.size(ops) > 0)
    d1, a1 = side(last, (F.size(ops) > 1) | (first["tag"] != "equal"))
    return F.struct(d0.alias("drop_first"), d1.alias("drop_last"), a0.alias("add_first"), a1.alias("add_last"))


def polish_edges(one: DataFrame, two: DataFrame, key: Sequence[str], emphasis: Sequence[str] = (), least: float = 0.6) -> DataFrame:
    """Edge words of a caption that two recognisers agree to drop or add. Acronyms and emphasised
    words are never dropped. ``one``/``two``: token diffs of the caption ``a`` (with the raw words
    ``raw``) against each model ``b``."""
    first = one.select(*key, "raw", F.col("b").alias("b1"), "ratio", edge_actions(F.col("ops")).alias("x"))
    other = two.select(*key, F.col("b").alias("b2"), edge_actions(F.col("ops")).alias("y"))
    both = first.join(other, list(key)).filter(F.col("ratio") >= least)
    wanted = F.array(*[F.lit(w) for w in emphasis]).cast("array<string>")

    def protected(w: Column) -> Column:
        core = F.btrim(w, F.lit(MARKS))
        return ((F.upper(core) == core) & (F.lower(core) != core) & (F.length(core) >= 2)) | F.array_contains(wanted, norm_strip(w))

    n = F.size("raw")
    d0 = F.least("x.drop_first", "y.drop_first")
    d1 = F.least("x.drop_last", "y.drop_last")
    hold0 = F.exists(F.slice("raw", 1, d0), protected)
    hold1 = F.exists(F.slice("raw", F.greatest(n - d1, F.lit(0)) + 1, d1), protected)
    both = both.withColumn("_d0", F.when(hold0, 0).otherwise(d0)).withColumn("_h0", hold0)
    both = both.withColumn("_d1", F.when(hold1, 0).otherwise(d1)).withColumn("_h1", hold1)
    said = lambda words, r: F.slice(words, r["j1"] + 1, r["j2"] - r["j1"])
    add = lambda side, hold: F.when(
        ~hold & F.col(f"x.{side}").isNotNull() & F.col(f"y.{side}").isNotNull()
        & (said(F.col("b1"), F.col(f"x.{side}")) == said(F.col("b2"), F.col(f"y.{side}"))),
        F.array_join(said(F.col("b1"), F.col(f"x.{side}")), " "),
    )
    return both.select(
        *key, F.col("_d0").alias("drop_first"), F.when(F.col("_d1") < n - F.col("_d0"), F.col("_d1")).otherwise(0).alias("drop_last"),
        add("add_first", F.col("_h0")).alias("add_first"), add("add_last", F.col("_h1")).alias("add_last"),
    )


def superseded_takes(segments: DataFrame, ahead: int = 12, within: float = 150.0, near: float = 0.72) -> DataFrame:
    """Takes repeated soon after: one of the next rows starts with the same words or is similar.
    Similarity is computed only where the lengths still allow it."""
    rows = position(segments, Layout(("media_id",), ("s", "e"), 3600.0), "pos")
    clean = F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-zà-ÿ ]", ""))
    rows = rows.select("media_id", "pos", "s", "e", clean.alias("n")).withColumn("w", F.slice(tokens("n"), 1, 3))
    asks = rows.select("media_id", F.col("pos").alias("at"), F.col("e").alias("end"), F.col("n").alias("n1"), F.col("w").alias("w1"))
    asks = asks.withColumn("pos", F.explode(F.sequence(F.col("at") + 1, F.col("at") + ahead)))
    pairs = asks.join(rows.select("media_id", "pos", "s", "n", "w"), ["media_id", "pos"]).filter(F.col("s") - F.col("end") <= within)
    same = (F.size("w1") >= 2) & (F.col("w1") == F.col("w"))
    short, long = F.least(F.length("n1"), F.length("n")), F.length("n1") + F.length("n")
    possible = 2 * short / long > near
    equal = pairs.filter(same).select("media_id", "at")
    close = pairs.filter(~same & possible).filter(string_ratio("n1", "n") > near).select("media_id", "at")
    hit = equal.unionByName(close).distinct().withColumnRenamed("at", "pos")
    return rows.join(hit, ["media_id", "pos"], "left_semi").select("media_id", "s", "e", F.col("n").alias("text"))


def align_words(asr: DataFrame, aligned: DataFrame, ahead: int = 4, chunk: int = 1 << 15, key: str = "media_id") -> DataFrame:
    """Recognised words with the time of the next aligned word that equals them, looking at most
    ``ahead`` aligned words past the last match. ``asr``/``aligned``: (key, pos, k, s, e).

    The pointer runs through a recording, so chunks are taken one after the other for all
    recordings at once, carrying only the pointer.
    """
    from cuewright.session import cut_lineage

    words = cut_lineage(asr.select(key, "pos", "k").withColumn("_c", F.floor(F.col("pos") / chunk)))
    refs = aligned.select(key, F.col("pos").alias("j"), F.col("k").alias("r"))
    field = words.schema[key]
    schema = T.StructType([field, T.StructField("pos", T.LongType()), T.StructField("j", T.LongType()), T.StructField("state", T.LongType())])
    state = words.select(key).distinct().withColumn("state", F.lit(0).cast("bigint"))
    last = int(words.agg(F.max("_c")).first()[0] or 0)
    parts = []

    def step(group: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame([])
        g = group.sort_values("pos")
        at = int(g["state"].iloc[0])
        seq = dict(zip(ref["j"], ref["r"], strict=True))
        found = []
        for k in g["k"]:
            m = next((i for i in range(at, at + ahead) if seq.get(i) == k), None)
            found.append(m)
            at = at if m is None else m + 1
        out = pd.DataFrame({key: g[key].to_numpy(), "pos": g["pos"].to_numpy(), "j": pd.array(found, dtype="Int64")})
        return out.assign(state=at)

    for c in range(last + 1):
        mine = words.filter(F.col("_c") == c).join(state, key)
        begun = state.select(F.col(key), (F.col("state") + 0).alias("_from"))
        near = refs.join(begun, key).filter((F.col("j") >= F.col("_from")) & (F.col("j") < F.col("_from") + ahead * chunk))
        near = near.select(F.col(key), "j", "r")
        done = cut_lineage(mine.groupBy(key).cogroup(near.groupBy(key)).applyInPandas(step, schema))
        parts.append(done)
        moved = done.groupBy(key).agg(F.max("state").alias("_s"))
        state = cut_lineage(state.join(moved, key, "left").select(key, F.coalesce("_s", "state").alias("state")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    timed = hits.filter("j is not null").select(key, "pos", "j").join(
        aligned.select(key, F.col("pos").alias("j"), F.col("s").alias("_s"), F.col("e").alias("_e")), [key, "j"]
    )
    out = asr.join(timed, [key, "pos"], "left")
    return out.select(
        key, "pos", "k", F.coalesce("_s", "s").alias("s"), F.coalesce("_e", "e").alias("e"), F.col("s").alias("asr_s"), F.col("_s").isNotNull().alias("aligned")
    )


def alignment_drift(words: DataFrame, key: Sequence[str] = ("media_id",)) -> DataFrame:
    """Share of aligned words, and the upper-middle and 90 % elements of their absolute shift."""
    shift = F.round(F.abs(F.col("s") - F.col("asr_s")), 3)
    base = words.groupBy(*key).agg(F.avg(F.col("aligned").cast("double")).alias("share"), F.count_if("aligned").alias("_n"))
    ranked = position(words.filter("aligned").select(*key, shift.alias("d"), "pos"), Layout(tuple(key), ("d", "pos"), 0.05), "_i")
    both = ranked.join(base, list(key))
    pick = lambda q: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(q)), F.col("d")))
    marks = both.groupBy(*key).agg(pick(0.5).alias("median"), pick(0.9).alias("p90"))
    return base.join(marks, list(key), "left").select(*key, "share", "median", "p90")


def locate(pairs: DataFrame, query: DataFrame, cand: DataFrame, chunk: int = 4096) -> DataFrame:
    """Best place of each query excerpt in each candidate recording: frame offset and correlation.

    ``pairs(query_id, media_id)``, ``query(query_id, frame, db)``, ``cand(media_id, frame, db)``. A
    candidate travels in chunks that overlap by the excerpt length, one row per chunk, and each
    row is correlated on its own.
    """
    q = query.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "db"))), lambda x: x["db"]).alias("q"))
    longest = int(q.agg(F.max(F.size("q"))).first()[0] or 1)
    low = F.floor(F.greatest(F.col("frame") - longest + 1, F.lit(0)) / chunk)
    packs = (
        cand.withColumn("_c", F.explode(F.sequence(low, F.floor(F.col("frame") / chunk))))
        .groupBy("media_id", "_c")
        .agg(F.array_sort(F.collect_list(F.struct("frame", "db"))).alias("f"))
        .select("media_id", F.get("f", F.lit(0))["frame"].alias("at"), F.transform("f", lambda x: x["db"]).alias("v"))
    )
    rows = pairs.join(q, "query_id").join(packs, "media_id")
    schema = T.StructType([rows.schema["query_id"], rows.schema["media_id"], T.StructField("frame", T.LongType()), T.StructField("score", T.DoubleType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, mid, x, at, v in zip(pdf["query_id"], pdf["media_id"], pdf["q"], pdf["at"], pdf["v"], strict=True):
                x, v = np.asarray(x, float), np.asarray(v, float)
                n = len(x)
                if len(v) < n or x.std() == 0:
                    continue
                x = (x - x.mean()) / x.std()
                total, square = np.cumsum(np.r_[0, v]), np.cumsum(np.r_[0, v * v])
                mean = (total[n:] - total[:-n]) / n
                sd = np.sqrt(np.maximum((square[n:] - square[:-n]) / n - mean**2, 1e-9))
                r = np.correlate(v - v.mean(), x, "valid") / n / sd
                k = int(np.argmax(np.round(r, 9)))
                out.append((qid, mid, int(at) + k, round(float(r[k]), 9)))
            if out:
                yield pd.DataFrame(out, columns=["query_id", "media_id", "frame", "score"])

    found = rows.mapInPandas(scan, schema)
    best = F.max_by(F.struct("frame", "score"), F.struct("score", -F.col("frame")))
    return found.groupBy("query_id", "media_id").agg(best.alias("b")).select("query_id", "media_id", "b.frame", "b.score")


def other_voice(sim: DataFrame, speech: DataFrame, keep: DataFrame, words: DataFrame, hop_ms: int = 100, below: float = 0.25, least: int = 2) -> DataFrame:
    """Stretches that do not sound like the main speaker, mostly speech and inside the kept part,
    with what is said there. ``sim(media_id, frame, sim)``."""
    low = written(runs(sim, F.col("sim") < below, least, measures={"sim": F.avg("sim")}))
    found = written(kept(seconds(low, hop_ms), keep, ["f0"]))
    frac = F.round(F.col("covered") / F.greatest(F.col("e") - F.col("s"), F.lit(1e-3)), 6)
    spoken = written(covered(found, speech, ["f0"]).filter(frac >= 0.5))
    heard = spoken.select("media_id").distinct()
    if heard.count() <= FEW_RECORDINGS:  # words of other recordings are not moved
        words = words.join(F.broadcast(heard), "media_id", "left_semi")
    return text_in(spoken, words, ["f0"]).select("media_id", "s", "e", F.round("sim", 6).alias("sim"), "text")


@lru_cache(1024)
def _word_set(text: str) -> frozenset[str]:
    return frozenset(text.lower().split())


def drop_overlapped(captions: DataFrame, min_block: float = 0.45, max_cps: float = 20.0, share: float = 0.5, squeeze: float = 0.6, key: Sequence[str] = ("clip_id",), chunk: int = FOLD_CHUNK) -> DataFrame:
    """Two people saying nearly the same at once leave two captions without time for both: the one
    with less room goes, the other takes its time. ``repaired`` marks captions of such origin.

    A null text counts as empty, a null mark as not set; captions without both times are left out. Runs
    may be of any length (``fold_runs``)."""
    key = list(key)
    lean = captions.filter("s is not null and e is not null").select(*key, "s", "e", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("repaired", F.lit(False)).alias("repaired"))
    rows = position(lean, Layout(tuple(key), ("s", "e", "text"), 3600.0), "pos")

    def room(start: float, end: float, text: str) -> float:
        return (end - start) / max(min_block, len(text) / max_cps)

    def meet(held: tuple, row: tuple) -> tuple | None:
        a, b = _word_set(held[2]), _word_set(row[2])
        alike = len(a & b) / max(len(a | b), 1) >= share and (held[3] or row[3])
        mine, its = room(*held[:3]), room(*row[:3])
        if not alike or min(mine, its) >= squeeze:
            return None
        return (min(held[0], row[0]), max(held[1], row[1]), *(held if mine >= its else row)[2:])

    state = T.StructType([rows.schema[c] for c in ("s", "e", "text", "repaired")])
    return fold_runs(rows, key, ["s", "e", "text", "repaired"], state, tuple, meet, chunk).drop("repaired")


def drop_block_duplicates(words: DataFrame, every: float = 600.0, near: float = 0.08, layout: Layout = Layout(("media_id",), ("seq",))) -> DataFrame:
    """Words repeated where two recognition blocks of ``every`` seconds meet: the same word, or the same
    pair, twice."""
    near_ = lags(words.withColumn("_w", F.struct(trim_punct("word").alias("k"), "s")), layout, "_w", 3, ahead=True)
    here, p1, p2, p3, n1 = (F.col(c) for c in ("_w", "lag_1", "lag_2", "lag_3", "lead_1"))

    def repeats(w: Column, one: Column, two: Column, after: Column) -> tuple[Column, Column]:
        meet = F.round(w["s"] / every)
        edge = (meet >= 1) & (F.abs(w["s"] - meet * every) < near)
        same = edge & F.coalesce(w["k"] == one["k"], F.lit(False))
        return same, edge & ~same & F.coalesce((w["k"] == two["k"]) & (after["k"] == one["k"]), F.lit(False))

    same, pair = repeats(here, p1, p2, n1)
    _, before = repeats(p1, p2, p3, here)
    return near_.filter(~same & ~pair & ~F.coalesce(before, F.lit(False))).select(*words.columns)


def repair_zero_time(words: DataFrame, least: float = 0.12, layout: Layout = Layout(("media_id",), ("seq",))) -> DataFrame:
    """Words that all start at the same instant are spread over the time up to the next start."""
    near = neighbours(words, layout, lag={"_ps": "s"})
    runs_ = islands(near, layout, F.col("_ps").isNull() | (F.col("s") > F.col("_ps") + 1e-6), "_i")
    group = runs_.groupBy(*layout.key, "_i").agg(
        F.min("s").alias("_s"), F.max_by("e", "seq").alias("_e"), F.count("*").alias("_n"), F.min("seq").alias("_q")
    )
    ahead = neighbours(group, Layout(layout.key, ("_i",)), lead={"_next": "_s"})
    ranked = position(runs_, Layout((*layout.key, "_i"), ("seq",), layout.width), "_r")
    both = ranked.join(ahead, [*layout.key, "_i"])
    end = F.greatest(F.coalesce("_next", "_e"), F.col("_s") + least * F.col("_n"))
    step = (end - F.col("_s")) / F.col("_n")
    many = F.col("_n") > 1
    return both.select(
        *[c for c in words.columns if c not in ("s", "e")],
        F.when(many, F.round(F.col("_s") + step * F.col("_r"), 3)).otherwise(F.col("s")).alias("s"),
        F.when(many, F.round(F.col("_s") + step * (F.col("_r") + 1), 3)).otherwise(F.col("e")).alias("e"), many.alias("repaired"),
    )


def patch_words(words: DataFrame, patches: DataFrame) -> DataFrame:
    """Speech the recogniser missed: words that start inside a patch ``(media_id, a, b, text)`` are
    replaced by its words, timed by their share of characters."""
    from cuewright.operators.intervals import point_in

    zones = patches.select("media_id", (F.col("a") - 1e-6).alias("s"), F.col("b").alias("e"))
    rest = point_in(words, "s", zones.select("media_id", "s", "e"), how="left_anti")
    w = tokens("text")
    total = F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x))
    upto = lambda i: F.aggregate(F.slice(w, 1, i), F.lit(0), lambda acc, x: acc + F.length(x))
    span = F.col("b") - F.col("a")
    made = F.transform(w, lambda x, i: F.struct(
        x.alias("word"), F.round(F.col("a") + span * upto(i) / total, 3).alias("s"), F.round(F.col("a") + span * upto(i + 1) / total, 3).alias("e")
    ))
    new = patches.select("media_id", F.inline(made))
    return rest.select("media_id", "word", "s", "e").unionByName(new)


def interpolate_words(words: DataFrame, least: float = 0.12) -> DataFrame:
    """Times for words the ear did not confirm (``s`` null), between their confirmed neighbours in
    the same caption, shared out by characters. A caption is a handful of words, so it is one
    window."""
    cap = Window.partitionBy("clip_id", "cap").orderBy("seq")
    known = F.col("s").isNotNull()
    w = words.withColumn("_g", F.sum(known.cast("int")).over(cap))
    before, after = cap.rowsBetween(Window.unboundedPreceding, -1), cap.rowsBetween(1, Window.unboundedFollowing)
    w = w.withColumn("_lo", F.coalesce(F.last("e", True).over(before), "cs")).withColumn("_hi", F.coalesce(F.first("s", True).over(after), "ce"))
    run = Window.partitionBy("clip_id", "cap", "_g")
    gap = F.when(~known, F.length("word") + 1)
    w = w.withColumn("_n", F.count(gap).over(run)).withColumn("_t", F.sum(gap).over(run)).withColumn("_c", F.sum(gap).over(run.orderBy("seq")))
    span = F.greatest("_hi", F.col("_lo") + least * F.col("_n")) - F.col("_lo")
    s = F.round(F.col("_lo") + span * (F.col("_c") - gap) / F.col("_t"), 3)
    e = F.round(F.col("_lo") + span * F.col("_c") / F.col("_t"), 3)
    return w.select(
        "clip_id", "cap", "seq", "word", F.when(known, F.col("s")).otherwise(s).alias("s"), F.when(known, F.col("e")).otherwise(e).alias("e"),
        F.when(known, "asr").otherwise("interp").alias("src"),
    )


def fill_starts(captions: DataFrame, duration: Column, layout: Layout = Layout(("clip_id",), ("seq",))) -> DataFrame:
    """Missing caption starts: each is the middle of the start before it (already filled) and the
    next known one, so the k-th missing one lies at next - (next - previous) / 2^k."""
    ranked = position(captions, layout, "_i")
    mark = F.when(F.col("start").isNotNull(), F.struct("start", "_i"))
    both = running(ranked.withColumn("_d", duration), layout, {"_p": ("last", mark), "_q": ("first_after", F.col("start"))})
    before = F.coalesce("_p.start", F.lit(0.0))
    after = F.coalesce("_q", "_d")
    k = F.col("_i") - F.coalesce("_p._i", F.lit(-1))
    filled = after - (after - before) / F.pow(F.lit(2.0), k)
    return both.select(*[c for c in captions.columns if c != "start"], F.coalesce("start", filled).alias("start"))


def time_captions(captions: DataFrame, onset: str, speech_end: str, duration: Column, pins: Mapping[str, float] | None = None, lead: float = 0.04) -> DataFrame:
    """Caption times from the words aligned to them: in ``lead`` before the onset, in order and 0.3 s
    apart, out a little after the speech ends. ``pins`` fix captions by how their text begins."""
    layout = Layout(("clip_id",), ("seq",))
    start = F.when(F.col(onset).isNotNull(), F.greatest(F.lit(0.0), F.col(onset) - lead))
    rows = captions.withColumn("start", start).withColumn("_known", F.col(onset).isNotNull()).withColumn("_dur", duration)
    rows = fill_starts(rows, F.col("_dur"), layout)
    for begin, t in (pins or {}).items():
        rows = rows.withColumn("start", F.when(F.col("text").startswith(begin), F.lit(float(t))).otherwise(F.col("start")))
    ranked = position(rows, layout, "_i")
    opening = (F.col("_i") == 0) & (F.col("start") < 0.15)
    ranked = ranked.withColumn("start", F.when(opening, 0.0).otherwise(F.col("start")))
    pushed = running(ranked, layout, {"_m": ("max", F.col("start") - F.col("_i") * 0.3)})
    pushed = pushed.withColumn("start", F.round(F.col("_m") + F.col("_i") * 0.3, 3))
    ahead = neighbours(pushed, layout, lead={"_next": "start"})
    limit = F.coalesce("_next", F.col("_dur") - 0.05)
    spoken = F.coalesce(F.col(speech_end), F.lit(0.0))
    end = F.least(limit, F.greatest(spoken + 0.25, F.col("start") + 0.5), F.col("_dur") - 0.05)
    return ahead.select("clip_id", "seq", "text", "start", F.round(end, 3).alias("end"))


def display_case(words: DataFrame, names: Sequence[str], openers: Sequence[str], key: str = "clip_id") -> DataFrame:
    """On-screen spelling: capitals inside a sentence go lower-case unless the word is a name: listed,
    next to another such capital, or seen twice and never in lower case."""
    layout = Layout((key,), ("seq",))
    core = F.rtrim(F.col("word"), F.lit(".,;:…"))
    first = F.substring(core, 1, 1)
    up = (F.upper(first) == first) & (F.lower(first) != first)
    shout = (F.upper(core) == core) & (F.lower(core) != core)
    low = F.regexp_replace(F.lower("word"), r"(?U)[^\wà-ÿ%]", "")
    rows = words.withColumn("_core", core).withColumn("_low", low).withColumn("_end", F.col("word").rlike("[.!?;:…]$"))
    rows = neighbours(rows, layout, lag={"_pe": "_end"})
    mid = up & ~F.coalesce("_pe", F.lit(True)) & ~shout
    rows = rows.withColumn("_mid", F.coalesce(mid, F.lit(False)))
    rows = rows.withColumn("_solid", F.col("_mid") & ~F.col("_low").isin(*openers))
    rows = neighbours(rows, layout, lag={"_ps": "_solid"}, lead={"_ns": "_solid"})
    lower_start = (F.lower(first) == first) & (F.upper(first) != first)
    seen = rows.groupBy(key, "_low").agg(F.count_if("_mid").alias("_caps"), F.max(lower_start).alias("_lower"))
    both = rows.join(seen, [key, "_low"])
    listed = norm_strip("_core").isin(*names)
    name = F.col("_solid") & (listed | F.coalesce("_ps", F.lit(False)) | F.coalesce("_ns", F.lit(False)) | ((F.col("_caps") >= 2) & ~F.col("_lower")))
    small = F.concat(F.lower(first), F.substring(F.col("_core"), F.lit(2), F.length("_core")))
    shown = F.when(name, F.col("_core")).when(F.col("_mid") & ~listed, small).otherwise(F.col("_core"))
    return both.select(key, "seq", "word", F.when(shown == "", F.col("word")).otherwise(shown).alias("shown"))


