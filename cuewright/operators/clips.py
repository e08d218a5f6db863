"""Clip-level operators: cue clipping, edges, tails, splices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import apply_fixes, slice_words, tokens
from cuewright.operators.intervals import asof, interval_join, offsets, text_once
from cuewright.session import written

# Openers, pointing words and bad closers of a clip (fixed values).
CONNECTIVES = (
    "então e mas aí daí porque pois tipo né só que ou também inclusive ainda enfim assim logo porém contudo "
    "entretanto senão"
).split()
DEICTICS = (
    "isso isto aquilo ele ela eles elas esse essa esses essas aquele aquela lá dele dela nisso disso daquilo"
).split()
BAD_TAILS = [
    *CONNECTIVES,
    *"de do da dos das em no na para pra com por pelo pela o a os as um uma como quando se".split(),
]
WORD_PATTERN = r"[\wÀ-ÿ%]+[.,!?;:…]*"
EDGE_MARKS = ".,!?;:…"


def clip_cues(
    cues: DataFrame,
    keep: DataFrame,
    fixes: Sequence[tuple[str, str]] = (),
    drop: float = 0.02,
    whole: float = 0.85,
) -> DataFrame:
    """Cues cut to the kept intervals and moved to output time. A cue of which only a part is kept
    shows the matching share of its words; a part without words is dropped."""
    placed = offsets(keep)
    hits = interval_join(cues.select("media_id", "seq", "s", "e"), placed, min_overlap=drop)
    s2, e2 = F.greatest("s", "b_s"), F.least("e", "b_e")
    span = F.greatest(F.lit(1e-6), F.col("e") - F.col("s"))
    cut = hits.select(
        "media_id", "seq", F.col("b_s").alias("keep_s"), (F.col("b_off") + (s2 - F.col("b_s"))).alias("s"),
        (F.col("b_off") + (e2 - F.col("b_s"))).alias("e"), ((s2 - F.col("s")) / span).alias("_f0"), ((e2 - F.col("s")) / span).alias("_f1"),
    )
    # The join above moves times only; each cue's words are split once and attached afterwards.
    spoken = cues.select("media_id", "seq", tokens(apply_fixes("text", fixes) if fixes else F.col("text")).alias("_w"))
    part = slice_words("_w", F.col("_f0"), F.col("_f1"), whole)
    shown = cut.join(spoken, ["media_id", "seq"]).select("media_id", "seq", "keep_s", "s", "e", F.array_join(part, " ").alias("text"))
    return shown.filter("text <> ''")


def clip_edges(clips: DataFrame, words: DataFrame, lo: float = 30.0, hi: float = 90.0, reach: float = 6.0) -> DataFrame:
    """Flags of a clip's opening, ending and length. ``clips(clip_id, media_id, first_s, last_e,
    kept)``; the words heard in the first and last seconds decide."""
    head = clips.select("clip_id", "media_id", F.col("first_s").alias("s"), (F.col("first_s") + reach).alias("e"))
    tail = clips.select("clip_id", "media_id", (F.col("last_e") - reach).alias("s"), F.col("last_e").alias("e"))
    # Both ends are read in one pass over the words.
    ends = head.withColumn("_end", F.lit("head")).unionByName(tail.withColumn("_end", F.lit("tail")))
    heard = written(text_once(ends, words, ["clip_id", "_end"], 0.05))
    said = heard.filter("_end = 'head'").select("clip_id", "media_id", F.col("text").alias("head"))
    closed = heard.filter("_end = 'tail'").select("clip_id", "media_id", F.col("text").alias("tail"))
    hw = F.regexp_extract_all("head", F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    tw = F.regexp_extract_all("tail", F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    bare = lambda x: F.lower(F.btrim(x, F.lit(EDGE_MARKS)))
    in_list = lambda x, values: F.array_contains(F.array(*[F.lit(v) for v in values]), x)
    first, last = F.get(hw, F.lit(0)), F.try_element_at(tw, F.lit(-1))
    initial = F.substring(first, 1, 1)
    open_end = ~(last.endswith(".") | last.endswith("!") | last.endswith("?"))
    flags = F.array_compact(
        F.array(
            F.when(in_list(bare(first), CONNECTIVES), "opens_with_connective"),
            F.when(F.exists(F.slice(hw, 1, 6), lambda x: in_list(bare(x), DEICTICS)), "dangling_reference"),
            F.when((F.lower(initial) == initial) & (F.upper(initial) != initial), "lower_case_opening"),
            F.when(last.endswith(",") | (in_list(bare(last), BAD_TAILS) & open_end), "bad_tail"),
            F.when(~F.col("kept").between(lo, hi), "duration_out_of_range"),
        )
    )
    both = clips.join(said, ["clip_id", "media_id"]).join(closed, ["clip_id", "media_id"])
    return both.select("clip_id", "media_id", F.explode(flags).alias("flag"))


def tail_check(
    clips: DataFrame, speech: DataFrame, end_fade: float = 0.35, reach: float = 3.0, tail_hold: Column | float = 0.0
) -> DataFrame:
    """Clips whose closing fade would swallow the last word, or whose end is inside speech.
    ``clips(clip_id, media_id, out)``."""
    hold = F.lit(tail_hold) if not isinstance(tail_hold, Column) else tail_hold
    zone = clips.select("clip_id", "media_id", (F.col("out") - reach).alias("s"), F.col("out").alias("e"))
    near = (
        interval_join(zone, speech.select("media_id", "s", "e"), lean="a")  # many words to a clip
        .groupBy("clip_id", "media_id")
        .agg(
            F.max("b_e").alias("_last"),
            F.max((F.col("b_s") < F.col("e")) & (F.col("b_e") > F.col("e"))).alias("_across"),
        )
    )
    joined = clips.join(near, ["clip_id", "media_id"], "left")
    end = F.least(F.coalesce("_last", "out"), F.col("out"))
    slack = F.round(F.col("out") - end + hold, 6)
    cut = F.coalesce("_across", F.lit(False)) & (hold == 0)
    return joined.filter(cut | (slack < end_fade + 0.15)).select(
        "clip_id", "media_id", F.round(end, 2).alias("s"), F.col("out").alias("e"), slack.alias("slack")
    )


def last_before(df: DataFrame, t: str, ref: DataFrame, ref_t: str, name: str) -> DataFrame:
    return asof(df, ref, t, ref_t, [ref_t], name="_x").withColumn(name, F.col("_x")[ref_t]).drop("_x")
