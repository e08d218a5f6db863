"""Timeline events, on-screen labels, feedback, rubrics and session logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from cuewright.functions.text import fold_accents
from cuewright.operators.intervals import SPAN_SECONDS, point_packs
from cuewright.operators.packs import listed
from cuewright.operators.slices import Layout, neighbours, running, top_rows
from cuewright.session import written

LETTER = "[a-zà-ÿ]"
# Weights of the insert rubric and of the music rubric (fixed values).
INSERT_WEIGHTS = {
    "claim_and_causal_fit": 0.30, "narrative_function": 0.20, "actor_scope_and_setting": 0.15,
    "literal_figurative_accuracy": 0.15, "emotional_and_client_fit": 0.10, "layout_and_technical_fit": 0.05,
    "license_certainty": 0.05,
}
MUSIC_WEIGHTS = {
    "semantic_and_emotional_fit": 0.30, "energy_and_speech_cadence": 0.20, "voice_compatibility": 0.20,
    "narrative_arc_and_impact": 0.15, "client_identity": 0.10, "license_certainty": 0.05,
}
INSERT_GATES, INSERT_PASS = {"claim_and_causal_fit": 4.0, "license_certainty": 5.0}, 4.0
MUSIC_GATES, MUSIC_PASS = {"license_certainty": 5.0}, 3.5


def max_gap(events: DataFrame, lengths: DataFrame, key: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Longest stretch without an event, counting the start and the end of the clip."""
    start = lengths.select(*key, F.lit(0.0).alias("t"))
    end = lengths.select(*key, F.col("duration").alias("t"))
    marks = events.select(*key, "t").unionByName(start).unionByName(end)
    near = neighbours(marks, Layout(tuple(key), ("t",), 3600.0), lag={"_p": "t"})
    return near.groupBy(*key).agg(F.max(F.col("t") - F.col("_p")).alias("max_gap"))


def edit_map(events: DataFrame, lengths: DataFrame, key: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Events per kind and per second of each clip."""
    counts = events.groupBy(*key, "kind").agg(F.count("*").alias("events"))
    return counts.join(lengths, list(key)).select(*key, "kind", "events", F.try_divide("events", "duration").alias("per_second"))


def label_overlaps(labels: DataFrame, dy: float = 44.0, slack: float = 8.0, grid: float = 64.0) -> DataFrame:
    """Pairs of labels of one panel that share a text line and cross sideways.
    ``labels(panel, id, y, x0, x1)``; a pair meets in one cell of a grid over the panel: that of the
    start of the one further right. The pairs may be many times the labels, so the cells are dealt
    over all shuffle partitions, however little the labels alone weigh."""
    row = F.floor(F.col("y") / dy)
    first = F.floor(F.col("x0") / grid)
    cells = F.sequence(first, F.greatest(first, F.floor(F.col("x1") / grid)))
    deal = [int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "panel", "_r", "_x"]
    left = labels.select("panel", "id", "y", "x0", "x1", row.alias("_r")).withColumn("_x", F.explode(cells))
    right = labels.select(
        "panel", F.col("id").alias("id2"), F.col("y").alias("y2"), F.col("x0").alias("u0"), F.col("x1").alias("u1"),
        F.explode(F.array(row - 1, row, row + 1)).alias("_r"), first.alias("_x"),
    )
    further = (F.col("x0") < F.col("u0")) | ((F.col("x0") == F.col("u0")) & (F.col("id") < F.col("id2")))
    pairs = left.repartition(*deal).join(right.repartition(*deal).hint("merge"), ["panel", "_r", "_x"]).filter(
        further & (F.col("id") != F.col("id2")) & (F.abs(F.col("y") - F.col("y2")) < dy)
        & (F.col("x0") < F.col("u1") - slack) & (F.col("u0") < F.col("x1") - slack)
    )
    return pairs.select("panel", F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"))


def unspoken_labels(labels: DataFrame, words: DataFrame, reach: float = 8.0) -> DataFrame:
    """Labels none of whose content words (four letters or more, first five compared) is said
    within ``reach`` seconds. ``labels(media_id, label_id, t, text)``."""
    stems = lambda text: F.array_distinct(
        F.transform(F.regexp_extract_all(fold_accents(text), F.lit(f"{LETTER}{{4,}}"), F.lit(0)), lambda w: F.substring(w, 1, 5))
    )
    # Joins take numbers with a fraction for other values than groups do and would move these rows once more.
    exact = F.col("label_id")
    if isinstance(labels.schema["label_id"].dataType, FractionalType):
        exact = (exact + F.lit(0.0)).cast("string")
    marked = labels.select("media_id", "label_id", exact.alias("_k"), "t", "text", F.array_join(stems("text"), "\n").alias("_stems"))
    named = marked.filter("media_id is not null and _k is not null")
    zones = named.filter("_stems <> ''").select("media_id", "_k", "_stems", "t")
    # What one row of a label tells holds for all of its rows: they ask together, too.
    several = written(named.groupBy("media_id", "_k").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    if not several.isEmpty():
        asked = named.join(several, ["media_id", "_k"]).groupBy("media_id", "_k").agg(
            F.collect_list(F.nullif("_stems", F.lit(""))).alias("_s"), F.array_distinct(F.collect_list("t")).alias("_t")
        )
        joined = F.array_join(F.array_distinct(F.split(F.array_join("_s", "\n"), "\n")), "\n")
        zones = zones.unionByName(asked.filter(F.size("_s") > 0).select("media_id", "_k", joined.alias("_stems"), F.explode("_t").alias("t")))
    zones = zones.select("media_id", "_k", "_stems", (F.col("t") - reach).alias("s"), (F.col("t") + reach).alias("e"))
    # A stem is four letters or more, so a word without four letters in a row holds none.
    heard = words.select("media_id", fold_accents("word").alias("_w"), F.col("s").alias("at")).filter(F.col("_w").rlike(f"{LETTER}{{4}}"))
    met = point_packs(heard, "at", ["_w", "at"], zones, bin_s=2 * SPAN_SECONDS)
    near = F.filter(F.arrays_zip(listed(met, "_w").alias("w"), listed(met, "at").alias("at")), lambda x: (x["at"] > F.col("s")) & (x["at"] < F.col("e")))
    # What is said around a label is one text, a word a line: a stem has letters only and is found inside a word.
    # Exploded, it is worked out once and not again for each stem.
    text = F.array_join(F.transform(near, lambda x: x["w"]), "\n")
    said = met.select("media_id", "_k", "_stems", F.explode(F.array(text)).alias("_said"))
    hits = said.filter(F.exists(F.split("_stems", "\n"), lambda stem: F.contains(F.col("_said"), stem)))
    # Equal texts are known by their hash, so that a text nobody reads is not moved.
    checked = marked.filter("_stems <> ''").groupBy("media_id", "label_id", "_k", "t", F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text"))
    return checked.join(hits.select("media_id", "_k").distinct(), ["media_id", "_k"], "left_anti").select("media_id", "label_id", "t", "text")


def feedback_summary(feedback: DataFrame, since=None) -> DataFrame:
    """Corrections counted by category, by client and by skill."""
    rows = feedback if since is None else feedback.filter(F.col("date") >= since)
    named = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("category", "client", "skill")])
    c = F.col
    sets = named.groupingSets([["category"], ["client"], ["skill"]], "category", "client", "skill").agg(F.count("*").alias("n"))
    dimension = F.when(c("category").isNotNull(), "category").when(c("client").isNotNull(), "client").otherwise("skill")
    return sets.select(dimension.alias("dimension"), F.coalesce("category", "client", "skill").alias("value"), "n")


def tail_feedback(feedback: DataFrame, n: int = 20, category: str | None = None, order: str = "event_id") -> DataFrame:
    """The last ``n`` entries, optionally of one category."""
    rows = feedback if category is None else feedback.filter(F.col("category") == category)
    return rows.orderBy(F.col(order).desc()).limit(n)


def pick_quota(cand: DataFrame, quotas: Sequence[tuple[int, int]], first: str, second: str) -> DataFrame:
    """Best candidates per episode under the first quota both speakers can fill.
    ``cand(episode, speaker, cand_id, score)``."""
    counts = cand.groupBy("episode").agg(
        F.count_if(F.col("speaker") == first).alias("_a"), F.count_if(F.col("speaker") == second).alias("_b")
    )
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in quotas])
    fits = F.filter(options, lambda q: (F.col("_a") >= q["a"]) & (F.col("_b") >= q["b"]))
    chosen = counts.select("episode", F.get(fits, F.lit(0)).alias("_q")).filter("_q is not null")
    top = top_rows(cand, ["episode", "speaker"], [F.col("score").desc(), F.col("cand_id")], max(max(q) for q in quotas))
    limit = F.when(F.col("speaker") == first, F.col("_q.a")).when(F.col("speaker") == second, F.col("_q.b")).otherwise(0)
    return top.join(chosen, "episode").filter(F.col("rank") <= limit).drop("_q")


def rubric_score(
    scores: DataFrame, weights: Mapping[str, float], gates: Mapping[str, float], passing: float, key: Sequence[str] = ("item",)
) -> DataFrame:
    """Weighted total of long scores ``(item, criterion, score)`` and approval: the total passes
    and every gated criterion reaches its minimum."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("criterion")), F.lit(0.0))
    gate = F.try_element_at(F.create_map(*[F.lit(x) for kv in gates.items() for x in kv]), F.col("criterion"))
    met = F.count_if(F.col("score") >= gate)
    total = F.round(F.sum(weight * F.col("score")), 6)
    out = scores.groupBy(*key).agg(total.alias("total"), met.alias("_met"))
    return out.select(*key, "total", ((F.col("total") >= passing) & (F.col("_met") == len(gates))).alias("approved"))


def session_cost(turns: DataFrame, targets: Sequence[str], sources: Sequence[str] = ()) -> DataFrame:
    """Turns, commands, images, tokens and minutes between the first and the last turn that names
    each target (or one of the source folders).

    Running totals are read at both ends, so turns are never paired with targets.
    """
    text = F.to_json("tools")
    extra = "".join("|" + s for s in sources)
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"(\b|/)({t}{extra})\b"), F.lit(t)) for t in targets]))
    images = F.size(F.filter("tools", lambda x: (x["name"] == "Read") & F.coalesce(x["input"]["file_path"], F.lit("")).rlike(r"\.(jpg|png)$")))
    commands = F.size(F.filter("tools", lambda x: x["name"] == "Bash"))
    base = turns.select("session", "idx", "ts", "output_tokens", "cache_read", images.alias("images"), commands.alias("commands"), named.alias("_t"))
    measures = ("output_tokens", "cache_read", "images", "commands")
    layout = Layout(("session",), ("idx",))
    summed = running(base, layout, {f"_c_{m}": ("sum", m) for m in measures})
    state = F.struct("idx", "ts", *[F.col(m) for m in measures], *[F.col(f"_c_{m}") for m in measures])
    hits = summed.select("session", F.explode("_t").alias("target"), state.alias("st"))
    ends = hits.groupBy("session", "target").agg(F.min_by("st", "st.idx").alias("a"), F.max_by("st", "st.idx").alias("b"))
    totals = [(F.col(f"b._c_{m}") - F.col(f"a._c_{m}") + F.col(f"a.{m}")).alias(m) for m in measures]
    minutes = (F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 60e6
    return ends.select("session", "target", (F.col("b.idx") - F.col("a.idx") + 1).alias("turns"), *totals, F.round(minutes, 3).alias("minutes"))
