"""File-path classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.text import _col


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))


def stem(path: Column | str) -> Column:
    name = F.regexp_extract(_col(path), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def guess_type(path: Column | str) -> Column:
    """Asset type from ordered extension and keyword rules."""
    low = F.lower(_col(path))
    ext = extension(path)
    return (
        F.when(ext.isin(*K.FONT_EXT), "fonte")
        .when(ext == "onnx", "modelo")
        .when(low.contains("burn"), "filmburn")
        .when(low.rlike(K.SFX_PATTERN) & ext.isin(*K.AUDIO_FX_EXT), "sfx")
        .when(ext.isin(*K.AUDIO_EXT), "musica")
        .when(low.contains("logo") & ext.isin(*K.LOGO_EXT), "logo")
        .when(ext.isin(*K.VIDEO_EXT) & low.rlike(K.OVERLAY_PATTERN), "overlay")
        .when(ext.isin(*K.VIDEO_EXT), "video")
        .when(ext.isin(*K.IMAGE_EXT), "imagem")
        .when(ext.isin(*K.LUT_EXT), "lut")
        .otherwise("outro")
    )


def classify_path(path: Column | str) -> Column:
    """raw / stock / vfx hint of a path, its stable-name and loose-root flags."""
    p = _col(path)
    return F.struct(
        F.when(p.rlike(K.RAW_HINT), "raw")
        .when(p.rlike(K.STOCK_HINT), "stock")
        .when(p.rlike(K.VFX_HINT), "vfx")
        .otherwise("none")
        .alias("hint"),
        stem(p).rlike(K.UNSTABLE_HINT).alias("unstable"),
        (~F.split(p, "/")[0].isin(*K.LAYOUT_REQUIRED)).alias("loose"),
    )
