"""Word-sequence operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import norm_key
from cuewright.operators.slices import Layout, lags

WORDS = Layout(("media_id",), ("seq",))


def fix_words(column: Column | str, fixes: Mapping[str, str]) -> Column:
    """Exact-word replacement from a fixed map, as one expression."""
    word = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(x) for kv in fixes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), word), word)


def join_split_tokens(words: DataFrame, layout: Layout = WORDS) -> DataFrame:
    """Glue tokens that start with a hyphen or a percent sign to the word before them."""
    key, inside = list(layout.key), [*layout.key, "_slice"]
    start = F.when(~F.col("word").rlike("^[-%]"), 1).otherwise(0)
    ordered = Window.partitionBy(*inside).orderBy(*layout.order)
    near = (
        words.select(*key, layout.slice_of().alias("_slice"), *dict.fromkeys([*layout.order, "seq"]), "word", "s", "e", start.alias("_start"))
        .withColumn("_i", F.sum("_start").over(ordered))
        .withColumn("_next", F.lead("_start").over(ordered))
    )
    # Most words stand alone between two starts: they are done. The others are gathered in their slice;
    # what touches a border of it, two pieces a slice at most, is gathered across slices.
    single = F.col("_start") + F.coalesce("_next", F.lit(0)) == 2
    alone = near.filter(single).select(*key, "seq", F.coalesce("word", F.lit("")).alias("word"), "s", "e", F.lit(1).cast("bigint").alias("parts"))
    pieces = near.filter(~single).groupBy(*inside, "_i").agg(
        F.min("seq").alias("seq"), F.collect_list(F.struct("seq", "word")).alias("_w"), F.min("s").alias("s"), F.max("e").alias("e"),
        F.count("*").alias("parts"), F.max((F.col("_i") == 0) | F.col("_next").isNull()).alias("_edge"),
    )
    home = pieces.withColumn("_home", F.when(~F.col("_edge"), F.col("_slice")))
    over = Window.partitionBy(*key, "_home").orderBy("_slice", "_i")
    whole = home.withColumn("_n", F.count(F.when(F.col("_i") > 0, 1)).over(over)).groupBy(*key, "_home", "_n").agg(
        F.min("seq").alias("seq"), F.sort_array(F.flatten(F.collect_list("_w"))).alias("_w"), F.min("s").alias("s"), F.max("e").alias("e"),
        F.sum("parts").alias("parts"),
    )
    word = F.array_join(F.transform("_w", lambda p: p["word"]), "").alias("word")
    return alone.unionByName(whole.select(*key, "seq", word, "s", "e", "parts"))


def repeated_words(words: DataFrame, layout: Layout = WORDS, allowed: tuple[str, ...] = ("é",)) -> DataFrame:
    """A word equal to the one before it, or a pair equal to the pair before it."""
    near = lags(words.withColumn("k", norm_key("word")), layout, "k", 3)
    same = (F.col("k") != "") & (F.col("k") == F.col("lag_1")) & ~F.col("k").isin(*allowed)
    pair = F.concat("lag_3", "lag_2") == F.concat("lag_1", "k")
    kinds = F.array_compact(
        F.array(F.when(same, F.lit("word")), F.when(pair, F.lit("pair")))
    )
    return near.withColumn("repeat", F.explode(kinds)).select(*words.columns, "repeat")
