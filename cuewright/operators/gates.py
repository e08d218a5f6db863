"""Rule gates: captions, deliveries, layout, levels. Findings are rows, never log lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import fold_accents, solid_length
from cuewright.operators.slices import Layout, neighbours, running

CAPTIONS = Layout(("clip_id",), ("seq",))

# Thresholds of the caption gate (fixed values).
OVERLAP_SLACK = 0.03
SHORT_SECONDS, LONG_SECONDS = 0.18, 6.0
HIGH_CPS = 24.0
HOOK_SECONDS, HOOK_CHARS = 0.28, 16

# Words a caption line should not end in (fixed values).
FUNCTION_WORDS = (
    "o a os as um uma e de da do das dos na no com que sem em se por para pra pro essa esse sua seu "
    "nossa nosso eu você ela ele é à já mais"
).split()


def _issue(when: Column, severity: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def explode_issues(df: DataFrame, issues: Sequence[Column]) -> DataFrame:
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*issues)))).select(
        *df.columns, "_f.severity", "_f.code"
    )


def caption_qc(
    captions: DataFrame, max_chars: int = 24, max_cps: float = 32.0, layout: Layout = CAPTIONS
) -> DataFrame:
    """Findings per caption: empty text, invalid time, overlap, duration, reading speed, length,
    word-list agreement and doubled words. ``w``/``em`` columns are checked when present."""
    text = F.trim(F.coalesce("text", F.lit("")))
    s, e = F.coalesce("s", F.lit(-1.0)), F.coalesce("e", F.lit(-1.0))
    base = captions.withColumn("text", text).withColumn("s", s).withColumn("e", e)
    valid = (F.col("s") >= 0) & (F.col("e") > F.col("s"))
    order = layout.order[0]
    reach = running(
        base.withColumn("_valid", valid),
        layout,
        {
            "_reach": ("max", F.when(valid, F.col("e"))),
            "_before": ("count", F.lit(1)),
        },
        inclusive=False,
    )
    dur = F.col("e") - F.col("s")
    chars = solid_length("text")
    speed = chars / F.greatest(dur, F.lit(0.001))
    ok = F.col("_valid")
    hook = (F.col("_before") == 0) & (dur >= HOOK_SECONDS) & (chars <= HOOK_CHARS)
    issues = [
        _issue(F.col("text") == "", "error", "empty_text"),
        _issue(~ok, "error", "invalid_time"),
        _issue(ok & (F.col("s") < F.greatest(F.col("_reach"), F.lit(-1.0)) - OVERLAP_SLACK), "error", "overlap"),
        _issue(ok & (dur < SHORT_SECONDS), "warning", "too_short"),
        _issue(ok & (dur > LONG_SECONDS), "warning", "too_long"),
        _issue(ok & (speed > max_cps) & hook, "warning", "fast_opening_hook_review"),
        _issue(ok & (speed > max_cps) & ~hook, "error", "cps_excessive"),
        _issue(ok & (speed <= max_cps) & (speed > HIGH_CPS), "warning", "cps_high"),
        _issue(ok & (F.length("text") > max_chars), "warning", "block_long"),
        _issue(ok & F.col("text").rlike(r"(?iU)\b(\w+)\s+\1\b"), "warning", "repeated_word"),
    ]
    if "w" in captions.columns:
        joined = F.trim(F.array_join("w", " "))
        issues.append(_issue(ok & F.col("w").isNotNull() & (joined != F.col("text")), "warning", "word_list_mismatch"))
        if "em" in captions.columns:
            issues.append(
                _issue(
                    ok & F.col("w").isNotNull() & F.col("em").isNotNull() & (F.size("w") != F.size("em")),
                    "error", "emphasis_length_mismatch",
                )
            )
    keep = [*layout.key, order, "s", "e", "text"]
    found = explode_issues(reach, issues)
    return found.select(*keep, "severity", "code", F.round(dur, 3).alias("duration"), F.round(speed, 2).alias("cps"))


def rollup_status(
    findings: DataFrame, entities: DataFrame, key: Sequence[str] = ("clip_id",), passed: str = "AUTOMATED_PASS"
) -> DataFrame:
    """One status per entity: FAIL with any error, REVIEW_REQUIRED with any warning, else pass."""
    counts = findings.groupBy(*key).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    joined = entities.select(*key).distinct().join(counts, list(key), "left").fillna(0, ["errors", "warnings"])
    status = F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "REVIEW_REQUIRED").otherwise(passed)
    return joined.withColumn("status", status)


def caption_rules(
    captions: DataFrame,
    duration: Column,
    brand: Mapping[str, str] | None = None,
    functions: Sequence[str] = tuple(FUNCTION_WORDS),
    layout: Layout = CAPTIONS,
) -> DataFrame:
    """Stricter caption rules: overlap over 0.02 s with the previous caption, past the end,
    reading speed over 24, lines over 26 characters or ending in a function word, brand spelling."""
    flat = captions.withColumn("_lines", F.split("text", "\n")).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    near = neighbours(flat, layout, lag={"_prev": "e"})
    speed = solid_length("text") / F.greatest(F.col("e") - F.col("s"), F.lit(0.001))
    last = F.array_compact(
        F.transform(F.slice("_lines", 1, F.greatest(F.size("_lines") - 1, F.lit(0))), _last_word)
    )
    stop = F.array(*[F.lit(w) for w in functions])
    issues = [
        _issue(F.col("s") < F.coalesce("_prev", F.lit(-1.0)) - 0.02, "error", "overlap"),
        _issue(F.col("e") > duration - 0.04, "error", "past_end"),
        _issue(speed > 24, "warning", "cps_high"),
        _issue(F.exists("_lines", lambda x: F.length(x) > 26), "warning", "line_long"),
        _issue(F.exists(last, lambda x: F.array_contains(stop, x)), "error", "line_ends_in_function_word"),
    ]
    for wrong, right in (brand or {}).items():
        issues.append(
            _issue(F.col("text").rlike("(?i)" + wrong) & ~F.col("text").contains(right), "error", "brand_spelling")
        )
    return explode_issues(near, issues).select(*layout.key, layout.order[0], "severity", "code")


def _last_word(line: Column) -> Column:
    found = F.regexp_extract_all(fold_accents(line), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def delivery_qc(
    probe: DataFrame,
    plan: DataFrame | None = None,
    width: int = 1080,
    height: int = 1920,
    fps: float = 30.0,
    min_mbps: float = 1.5,
    max_mbps: float = 10.0,
) -> DataFrame:
    """Findings per delivered file. Rules apply to the columns that are present: size, fps, codec,
    pixel format, bit rate, colour tags, loudness, true peak, black and freeze events, and the
    planned duration."""
    have = set(probe.columns)
    df = probe if plan is None else probe.join(plan.select("clip_id", "total"), "clip_id", "left")
    c = F.col
    issues = [
        _issue((c("width") != width) | (c("height") != height), "error", "wrong_dimensions"),
        _issue(F.abs(c("fps") - fps) > 0.05, "error", "wrong_fps"),
    ]
    if "codec" in have:
        issues.append(_issue(~c("codec").eqNullSafe("h264"), "error", "wrong_video_codec"))
    if "pix_fmt" in have:
        issues.append(_issue(~c("pix_fmt").eqNullSafe("yuv420p"), "error", "wrong_pixel_format"))
    if "bitrate" in have:
        issues += [
            _issue((c("bitrate") > 0) & (c("bitrate") < min_mbps * 1e6), "warning", "video_bitrate_low"),
            _issue(c("bitrate") > max_mbps * 1e6, "error", "video_bitrate_high"),
        ]
    if "color" in have:
        wanted = {"color_range": "tv", "color_space": "bt709", "color_transfer": "bt709", "color_primaries": "bt709"}
        bad = F.lit(False)
        for field, value in wanted.items():
            bad = bad | ~c("color")[field].eqNullSafe(value)
        issues.append(_issue(bad, "error", "incomplete_rec709_metadata"))
    issues += [
        _issue(~c("lufs").between(-19, -13), "warning", "loudness_outside_social_range"),
        _issue(c("true_peak") > -1, "error", "true_peak_too_high"),
    ]
    if "black" in have:
        edge = F.greatest(F.lit(1.2), c("duration") - 1.5)
        issues.append(
            _issue(F.exists("black", lambda x: (x["s"] > 1.2) & (x["s"] < edge)), "warning", "unexpected_black_frames")
        )
    if "freeze" in have:
        issues.append(_issue(F.size("freeze") > 0, "warning", "long_freeze"))
    if plan is not None:
        issues.append(_issue(F.abs(c("duration") - (c("total") + 0.8)) > 2.0, "error", "duration_mismatch"))
    return explode_issues(df, issues).select("clip_id", "severity", "code")


def verify_cut(
    probe: DataFrame,
    expected_duration: Column,
    expected_fps: float,
    min_width: int,
    min_height: int,
    duration_tol: float = 0.20,
    fps_tol: float = 0.05,
) -> DataFrame:
    """Every named check of a cut with its outcome and the measured value."""
    def check(name: str, passed: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))

    c = F.col
    checks = F.array(
        check("minimum_width", c("width") >= min_width, c("width")),
        check("minimum_height", c("height") >= min_height, c("height")),
        check("frame_rate", F.abs(c("fps") - expected_fps) <= fps_tol, c("fps")),
        check("duration", F.abs(c("duration") - expected_duration) <= duration_tol, c("duration")),
    )
    return probe.select("clip_id", F.inline(checks))


def split_by_duration(df: DataFrame, max_s: float = 300.0, duration: str = "duration") -> tuple[DataFrame, DataFrame]:
    """Media short enough to check, and the over-long ones set aside; unreadable length counts as 0."""
    length = F.coalesce(F.col(duration).try_cast("double"), F.lit(0.0))
    return df.filter(length <= max_s), df.filter(length > max_s)


def missing_keywords(keywords: DataFrame, captions: DataFrame, key: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Keywords of a clip (``keywords`` array) that none of its captions holds, ignoring case."""
    both = captions.select(*key, F.lower("text").alias("_text")).join(keywords, list(key))
    held = both.select(*key, F.explode(F.filter("keywords", lambda k: F.contains("_text", F.lower(k)))).alias("keyword"))
    wanted = keywords.select(*key, F.explode(F.array_distinct("keywords")).alias("keyword"))
    return wanted.join(held.distinct(), [*key, "keyword"], "left_anti")


def missing(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return required.join(present, list(on), "left_anti")


def all_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def override_captions(plan: DataFrame, edited: DataFrame, key: str = "clip_id") -> DataFrame:
    """Planned captions of the clips nobody edited, plus the edited ones of the others."""
    ids = edited.select(key).distinct()
    return plan.join(ids, key, "left_anti").unionByName(edited, allowMissingColumns=True)


def plan_vs_delivery(plan: DataFrame, probe: DataFrame, pad: float = 0.8, tol: float = 2.0) -> DataFrame:
    """Planned and delivered length per clip; ``ok`` is null when nothing was delivered."""
    expected = F.col("total") + pad
    return plan.join(probe.select("clip_id", "duration"), "clip_id", "left").select(
        "clip_id", expected.alias("expected"), "duration", (F.abs(F.col("duration") - expected) <= tol).alias("ok")
    )


def batch_summary(items: DataFrame, findings: DataFrame, reports: DataFrame, batch: str, key: str = "clip_id") -> DataFrame:
    """Outcome counts per batch; an item without a report is a tool error."""
    status = rollup_status(findings, items, (key,))
    have = reports.select(key, F.lit(True).alias("_has")).distinct()
    joined = items.join(status, key).join(have, key, "left")
    final = F.when(F.col("_has").isNull(), "TOOL_ERROR").otherwise(F.col("status"))
    return joined.withColumn("status", final).groupBy(batch).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.count_if(F.col("status") == "TOOL_ERROR").alias("tool_errors"),
    )


def review_sample(captions: DataFrame, n: int, key: str = "clip_id") -> DataFrame:
    """Captions to look at: both ends, the longest, the fastest and an even spread, first ``n``."""
    from cuewright.operators.slices import position

    ranked = position(captions, Layout((key,), ("seq",)), "i")
    speed = F.length("text") / F.greatest(F.col("e") - F.col("s"), F.lit(0.001))
    stats = ranked.groupBy(key).agg(
        F.count("*").alias("total"),
        F.max_by("i", F.struct(F.length("text"), -F.col("i"))).alias("longest"),
        F.max_by("i", F.struct(speed, -F.col("i"))).alias("fastest"),
    )
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: F.rint(j * (F.col("total") - 1) / float(max(n - 1, 1))).cast("bigint"),
    )
    picks = F.array_union(
        F.array(F.lit(0).cast("bigint"), F.col("total") - 1, F.col("longest"), F.col("fastest")), spread
    )
    everything = F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)
    chosen = F.when(F.col("total") <= n, everything).otherwise(F.slice(F.array_sort(F.array_distinct(picks)), 1, n))
    wanted = stats.select(key, F.explode(chosen).alias("i"))
    return ranked.join(wanted, [key, "i"], "left_semi").drop("i")


def keyword_hits(segments: DataFrame, pattern: str) -> DataFrame:
    return segments.filter(F.col("text").rlike("(?iu)" + pattern))


def stretched(words: DataFrame, over: float = 1.0, letters: int = 8) -> DataFrame:
    """Short words that take suspiciously long."""
    core = F.btrim("word", F.lit(".,!?;:"))
    return words.filter((F.col("e") - F.col("s") > over) & (F.length(core) <= letters))
