"""Joins against a small side when one key may hold a large part of the big side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def attach(big: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``big`` to a relation with one row per key. The key rows are copied once per salt and
    the big rows spread over the salts, so a hot key is shared by ``salts`` tasks. Estimates of size leave out the
    copies, so they are merged and never broadcast."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts))
    left = big.withColumn("_salt", spread.cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")
