"""Mixing sources to target weights by drawing fixed-length token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, numbered, permuted, word_count

#: Longest block in words, output shards of the drawn mix, and how often a word may be repeated.
BLOCK, OUT_SHARDS, MOST = 64, 64, 3
_CHUNK = 4096


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source (``source``, ``source_size``, ``sid``, ``weight``, ``target``).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; together they get the sum of all
    sizes by weight, none more than ``most`` times its own size. The level of the sources under
    their bound follows in closed form: in order of bound per unit of weight, the first source whose
    bound is not under what the rest would give it is where the bounded ones end.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    rising = every.orderBy(F.col("_cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))).alias("_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))).alias("_weights"),
    )
    level = F.min(F.when(F.col("_left") / F.col("_weights") <= F.col("_cap") / F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), F.col("_left") / F.col("_weights"))))
    per = per.withColumn("_level", level.over(every).getField("col2"))
    share = F.col("_level") * F.col("weight")
    target = F.when(F.col("_level").isNull() | (share > F.col("_cap")), F.col("_cap")).otherwise(share)
    return per.select("source", "source_size", "sid", "weight", target.alias("target"))


def _blocks(targets: DataFrame, block: int) -> DataFrame:
    """Layout of each source's token stream: block length, number of blocks, number of draws, and
    the words that the last draw takes, so that a source's draws meet its target."""
    size, b = F.col("source_size"), F.col("block_words")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size).cast("long"), F.lit(MOST).cast("long"))).otherwise(0)
    return (
        targets.withColumn("block_words", F.greatest(F.ceil(size / F.greatest(F.ceil(size / block), F.lit(1))), F.lit(1)).cast("long"))
        .withColumn("n_blocks", F.ceil(size / b).cast("long"))
        .withColumn("_whole", whole)
        .withColumn("_rest", F.least(F.round(F.col("target") - F.col("_whole") * size).cast("long"), size))
        .withColumn("n_draws", F.col("_whole") * F.col("n_blocks") + F.ceil(F.col("_rest") / b).cast("long"))
        .withColumn("last_words", F.col("_rest") - (F.ceil(F.col("_rest") / b).cast("long") - 1) * b)
        .withColumn("last_words", F.when(F.col("_rest") > 0, F.col("last_words")).otherwise(b))
    )


def draws(layout: DataFrame, seed: str = "mix", out_shards: int = OUT_SHARDS) -> DataFrame:
    """One row per slot of the mix: ``sid``, ``draw``, ``out_shard``, ``epoch``, ``block``, ``words``.

    Each slot of a source goes to an output shard by a keyed hash, so a source's counts per shard
    are a multinomial draw, given its total; the total is fixed because no document may be taken
    more than ``MOST`` times. Slot i of a source takes block perm(i mod n_blocks), where perm is the
    source's pseudorandom permutation in epoch i div n_blocks.
    """
    chunks = layout.filter("n_draws > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_draws") - 1) / _CHUNK).cast("long"))))
    chunks = chunks.repartition("sid", "_chunk")
    first = F.col("_chunk") * _CHUNK
    slots = chunks.withColumn("draw", F.explode(F.sequence(first, F.least(first + (_CHUNK - 1), F.col("n_draws") - 1))))
    slots = slots.withColumn("epoch", F.floor(F.col("draw") / F.col("n_blocks")).cast("int"))
    key = F.concat_ws("/", F.lit(seed), F.col("sid").cast("string"), F.col("epoch").cast("string"))
    return slots.select(
        "sid",
        "draw",
        "epoch",
        F.pmod(F.xxhash64(F.lit(seed), "sid", "draw"), F.lit(out_shards)).cast("int").alias("out_shard"),
        permuted(F.pmod("draw", "n_blocks"), F.col("n_blocks"), key).alias("block"),
        F.when(F.col("draw") == F.col("n_draws") - 1, F.col("last_words")).otherwise(F.col("block_words")).alias("words"),
    )


def mix(rows: DataFrame, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` (any columns, ``source``, ``size``; ``_h1``, ``_h2`` tell different rows apart).

    First result: the rows with ``sid``, ``_rn`` (their number within the source), ``source_size``,
    ``target``, ``taken`` (words the mix takes, repeats counted) and ``shards`` (output shards that draw it, each
    with the words it takes). Second: ``sid``, ``_rn``, ``epoch``, ``out_shard``, ``first``, ``until``: the word ranges taken. Rows without words are kept with
    nothing taken; a null source is a source; an empty table gives no rows.
    """
    targets = source_targets(rows)
    layout = cut_lineage(_blocks(targets, block))
    same = F.col("source").eqNullSafe(F.col("_s"))
    small = layout.select(F.col("source").alias("_s"), "sid", "source_size", "target", "block_words")
    keyed = cut_lineage(numbered(rows, ["source"], ["_h1", "_h2", "size"], "size").join(small, same).drop("_s"))
    b, start, end = F.col("block_words"), F.col("_off"), F.col("_off") + F.col("size")
    pieces = keyed.filter("size > 0").select("sid", "_rn", "_off", "size", "block_words", F.explode(F.sequence(F.floor(start / b).cast("long"), F.floor((end - 1) / b).cast("long"))).alias("block"))
    pieces = pieces.select("sid", "_rn", "block", "_off", (F.greatest(start, F.col("block") * b) - F.col("block") * b).alias("_from"), (F.least(end, (F.col("block") + 1) * b) - F.col("block") * b).alias("_to"), (F.col("block") * b).alias("_at"))
    # the planner takes a slot table for as small as the layout it is exploded from, and would broadcast it
    hit = pieces.join(draws(layout, seed).hint("merge"), ["sid", "block"]).withColumn("_to", F.least("_to", "words")).filter("_to > _from")
    ranges = hit.select("sid", "_rn", "epoch", "out_shard", (F.col("_at") + F.col("_from") - F.col("_off")).alias("first"), (F.col("_at") + F.col("_to") - F.col("_off")).alias("until"))
    # one shuffle serves both groupings and the join: a row and its shards (at most as many as there are) stay together
    words = ranges.select("sid", "_rn", "out_shard", (F.col("until") - F.col("first")).alias("words")).repartition("sid", "_rn")
    words = words.groupBy("sid", "_rn", "out_shard").agg(F.sum("words").alias("words"))
    taken = words.groupBy("sid", "_rn").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct(F.col("out_shard").alias("shard"), "words"))).alias("shards"))
    out = keyed.drop("_off", "block_words").join(taken, ["sid", "_rn"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    out = out.withColumn("shards", F.coalesce("shards", F.array().cast("array<struct<shard:int,words:bigint>>")))
    return out, ranges


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash over all columns: rows equal in both are taken for equal. Nulls, which a hash
    skips, count by their places; maps are hashed as JSON."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = F.concat(*[F.when(p.isNull(), "1").otherwise("0") for p in parts])
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit("again"), *parts, nulls)


def _lean(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    one, two = row_hashes(docs)
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), one.alias("_h1"), two.alias("_h2"))


def mix_counts(docs: DataFrame, block: int = BLOCK, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, ``size`` in words, ``source_size``, ``target`` of its source, ``taken``, and ``shards``: the
    output shards that draw blocks of it, in order, with the words each takes (empty where none does)."""
    out, _ = mix(cut_lineage(_lean(docs, id_col, text_col, source_col)), block, seed)
    return out.select(F.col("_id").alias(id_col), "size", F.col("source_size").cast("long"), "target", "taken", "shards")


def pieces_of(text: Column) -> Column:
    """A text cut before the blanks that follow a word; joined without a separator they are the text."""
    return F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = None) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for each document and epoch that
    takes words of it, its text the words taken, in order (the text as it is where all are taken).
    With ``shard_col`` there is a row for each output shard as well, with its number in that last column.

    The plan is made on rows without texts. Texts move once, by row hash; equal rows are one row
    there, and each of them meets its own draws.
    """
    out, ranges = mix(cut_lineage(_lean(docs, id_col, text_col, source_col)), block, seed)
    spans = ranges.groupBy("sid", "_rn", "epoch", *(["out_shard"] if shard_col else [])).agg(F.array_sort(F.collect_list(F.struct("first", "until"))).alias("_spans"), F.sum(F.col("until") - F.col("first")).alias("_sum"))
    spans = spans.join(out.select("sid", "_rn", "_h1", "_h2", "size"), ["sid", "_rn"]).drop("sid", "_rn")
    one, two = row_hashes(docs)
    full = docs.select(F.struct("*").alias("_doc"), one.alias("_h1"), two.alias("_h2")).dropDuplicates(["_h1", "_h2"])
    both = full.join(spans, ["_h1", "_h2"])
    text, part = F.col("_doc").getField(text_col), F.col("_sum") < F.col("size")
    both = both.withColumn("_parts", F.when(part, pieces_of(text)))
    cut = F.array_join(F.transform("_spans", lambda s: F.array_join(F.slice("_parts", s["first"].cast("int") + 1, (s["until"] - s["first"]).cast("int")), "")), "")
    both = both.withColumn("_new", F.when(part, cut).otherwise(text))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("_new").alias(c))
        elif c == "n_chars":
            cols.append(F.length("_new").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("_doc").getField(c).alias(c))
    return both.select(*cols, *([F.col("out_shard").alias(shard_col)] if shard_col else []))
