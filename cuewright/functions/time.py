"""Timecodes, dates, frames and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.text import _col


def to_seconds(c: Column | str, fps: float | None = None) -> Column:
    """``h:m:s,ms``, ``m:s``, ``s`` and, when ``fps`` is given, ``h:m:s:frames``."""
    parts = F.split(F.replace(F.btrim(_col(c)), F.lit(","), F.lit(".")), ":")
    clock = F.slice(parts, 1, F.least(F.size(parts), F.lit(3))) if fps else parts
    base = F.aggregate(clock, F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))
    if fps is None:
        return base
    frame = F.when(F.size(parts) == 4, F.element_at(parts, -1).try_cast("double") / F.lit(float(fps)))
    return base + F.coalesce(frame, F.lit(0.0))


def fmt_seconds(c: Column | str, style: str = "hms", fps: int = 30) -> Column:
    """``hms`` 00:00:00, ``srt`` 00:00:00,000, ``tenth`` 0:00:00.0, ``frames`` 00:00:00:00."""
    t = _col(c)
    if style == "hms":
        whole = F.floor(t)
        return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    if style == "srt":
        ms = F.round(t * 1000).cast("bigint")
        return F.format_string(
            "%02d:%02d:%02d,%03d",
            F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000,
        )
    if style == "tenth":
        tenths = F.round(t * 10).cast("bigint")
        return F.format_string(
            "%d:%02d:%02d.%d",
            F.floor(tenths / 36000), F.floor(tenths % 36000 / 600), F.floor(tenths % 600 / 10), tenths % 10,
        )
    if style == "frames":
        whole = F.floor(t)
        return F.format_string(
            "%02d:%02d:%02d:%02d",
            F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60,
            F.round((t - whole) * fps).cast("bigint"),
        )
    raise ValueError(f"unknown timecode style {style}")


def fps_ratio(c: Column | str) -> Column:
    """Rational frame rate as a number, 0 for a zero denominator or unreadable text."""
    parts = F.split(_col(c), "/")
    den = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), den), F.lit(0.0))


def to_frame(c: Column | str, fps: float) -> Column:
    return F.round(_col(c) * F.lit(float(fps))).cast("bigint")


def quantise(c: Column | str, step: float, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(_col(c) / F.lit(step)) * F.lit(step)))


def fmt_br(c: Column | str, digits: int = 0) -> Column:
    """Number text with a point between thousands and a decimal comma."""
    return F.translate(F.format_number(_col(c), digits), ",.", ".,")


def pct_br(c: Column | str, digits: int = 1) -> Column:
    return F.concat(fmt_br(c, digits), F.lit("%"))


def parse_export_date(c: Column | str, kind: str, year: int | None = None, shift_hours: int = 4) -> Column:
    """Dates as three platforms export them: ``Sep 24, 2026``, ``21 September`` (year given),
    and ``09/24/2026 13:05`` moved by a fixed number of hours."""
    text = _col(c)
    if kind == "month_first":
        return F.try_to_timestamp(text, F.lit("MMM d, yyyy")).cast("date")
    if kind == "day_month":
        return F.try_to_timestamp(F.concat(text, F.lit(f" {year}")), F.lit("d MMMM yyyy")).cast("date")
    if kind == "shifted":
        return F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm")) + F.make_interval(hours=F.lit(shift_hours))
    raise ValueError(f"unknown export date kind {kind}")
