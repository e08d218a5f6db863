"""Signal and colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.text import _col


def to_db(mean_square: Column | str) -> Column:
    return F.lit(20.0) * F.log10(F.sqrt(_col(mean_square)) + F.lit(1e-9))


def from_db(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), _col(db) / F.lit(20.0))


def skin_vector(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Vectorscope position of a colour: u, v, angle in degrees and chroma.

    Luma uses the 0.299 / 0.587 / 0.114 weights, u and v the 0.492 / 0.877 scales.
    """
    red, green, blue = _col(r), _col(g), _col(b)
    luma = red * F.lit(0.299) + green * F.lit(0.587) + blue * F.lit(0.114)
    u = F.lit(0.492) * (blue - luma)
    v = F.lit(0.877) * (red - luma)
    return F.struct(
        u.alias("u"),
        v.alias("v"),
        F.degrees(F.atan2(v, u)).alias("angle"),
        F.hypot(u, v).alias("chroma"),
    )


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm2(a) * norm2(b))
