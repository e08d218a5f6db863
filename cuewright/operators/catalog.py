"""Asset catalogue: identity by content hash, duplicates, merge, relink, search, layout audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.paths import classify_path, extension, guess_type, stem
from cuewright.functions.text import slug, tag_cost
from cuewright.operators.salting import attach
from cuewright.operators.slices import Layout, neighbours, position, running


def duplicate_files(files: DataFrame) -> DataFrame:
    """Every path of each group of equal files, with the number of copies and the first path.
    One row per path: a group of copies is never gathered."""
    groups = (
        files.groupBy("size", "hash")
        .agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
        .filter("copies > 1")
    )
    return attach(files, groups, ["size", "hash"], "inner").select("path", "size", "hash", "copies", "first_path")


def pending(inputs: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without a finished output of the same identity, content and model."""
    return inputs.join(manifest.select(*keys).distinct(), list(keys), "left_anti")


def edit_tags(tags: Column | str, add: Column, replace: bool = False) -> Column:
    """Sorted tag set after adding to it or replacing it."""
    old = F.col(tags) if isinstance(tags, str) else tags
    return F.array_sort(F.array_distinct(F.filter(add if replace else F.array_union(old, add), lambda t: t != "")))


def relink(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets whose path is gone: relinked to a file of the same content, or missing."""
    gone = assets.join(files.select("path").distinct(), "path", "left_anti")
    by_hash = files.groupBy("qhash").agg(F.min("path").alias("new_path"))
    found = attach(gone, by_hash, ["qhash"], "left")
    return found.withColumn("state", F.when(F.col("new_path").isNull(), "missing").otherwise("relinked"))


def search_assets(
    assets: DataFrame, terms: Sequence[str], type: str | None = None, client: str | None = None, n: int = 20
) -> DataFrame:
    """Best ``n`` assets for the terms: 3 points for a term in the name or among the tags, 1 for
    one elsewhere in the item's text, 2 more for a favourite that matched at all."""
    pool = assets
    if type:
        pool = pool.filter(F.col("type") == type)
    if client:
        pool = pool.filter(F.col("client").isin(client, "_global"))
    blank = F.lit("")
    fields = [F.col(c) for c in ("id", "name", "type", "client")]
    fields += [F.array_join("tags", " "), F.coalesce("note", blank), F.coalesce("source", blank)]
    hay, name = slug(F.concat_ws(" ", *fields)), slug("name")
    score = F.lit(0)
    for term in terms:
        t = slug(F.lit(term))
        strong = F.contains(name, t) | F.array_contains("tags", t)
        score = score + F.when(F.contains(hay, t), F.when(strong, 3).otherwise(1)).otherwise(0)
    favourite = F.array_contains("tags", F.lit("favorito"))
    total = score + F.when((score > 0) & favourite, 2).otherwise(0) if terms else F.lit(1)
    return pool.withColumn("score", total).filter("score > 0").orderBy(F.col("score").desc(), "id").limit(n)


def base_id(type_col: str = "type", name: str = "name") -> Column:
    return F.substring(F.concat_ws("-", type_col, slug(stem(name))), 1, 70)


def merge_assets(assets: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue after taking in new files, and where known content was seen again.

    Known content (same hash) gains tags and notes; new content becomes an item with a free id.
    Sightings are rows (asset id, path), since one content may have any number of copies.
    """
    tagged = incoming.select("qhash", F.explode_outer("tags").alias("_t"), "note", "path").groupBy("qhash").agg(
        F.array_sort(F.collect_set("_t")).alias("_tags"),
        F.array_sort(F.collect_set(F.nullif("note", F.lit("")))).alias("_notes"),
        F.min("path").alias("_first"),
    )
    known = assets.join(tagged, "qhash", "left")
    fresh_notes = F.filter(F.coalesce("_notes", F.array()), lambda n: ~F.contains(F.coalesce("note", F.lit("")), n))
    note = F.concat_ws(" | ", F.nullif("note", F.lit("")), F.nullif(F.array_join(fresh_notes, " | "), F.lit("")))
    updated = known.select(
        *[c for c in assets.columns if c not in ("tags", "note")],
        edit_tags("tags", F.coalesce("_tags", F.array())).alias("tags"), note.alias("note"),
    )
    new = tagged.join(assets.select("qhash"), "qhash", "left_anti")
    named = new.withColumn("path", F.col("_first")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    named = named.withColumn("type", guess_type("path")).withColumn("_base", base_id())
    ranked = _free_numbers(named, assets)
    index = F.col("_index")
    made = ranked.select(
        F.when(index == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", index)).alias("id"),
        "name", "type", "qhash", "path", F.col("_tags").alias("tags"), F.array_join("_notes", " | ").alias("note"),
    )
    catalog = updated.unionByName(made, allowMissingColumns=True)
    ids = catalog.select("qhash", F.col("id"), F.col("path").alias("_own"))
    seen = attach(incoming.select("qhash", "path").distinct(), ids, ["qhash"], "inner").filter(F.col("path") != F.col("_own"))
    return catalog, seen.select("id", "path")


def _free_numbers(named: DataFrame, assets: DataFrame) -> DataFrame:
    """Numbers (``_index``) for new items with the same ``_base``: 1 stands for the base itself, k for
    base-k; numbers that catalogued ids use are passed over.

    A used number u with r used ones below it has u - 1 - r free numbers in front, so the new item
    of rank i comes behind it if that is at most i. Used numbers and new items are merged in that
    order, and a running count of the used ones gives each item its number.
    """
    number = F.regexp_extract("id", "-([2-9]|[1-9][0-9]{1,8})$", 1)
    used = assets.select(F.col("id").alias("_base"), F.lit(1).cast("bigint").alias("_u")).unionByName(
        assets.filter(number != "").select(F.regexp_extract("id", "^(.*)-[0-9]+$", 1).alias("_base"), number.cast("bigint").alias("_u"))
    ).distinct()
    used = used.join(named.select("_base").distinct(), "_base", "left_semi")
    below = position(used, Layout(("_base",), ("_u",), 1 << 10), "_r")
    spread = named.withColumn("_h", F.pmod(F.xxhash64("qhash"), F.lit(1 << 20)))
    ranked = position(spread, Layout(("_base",), ("_h", "qhash"), 1 << 10), "_i").withColumnRenamed("_i", "_at").withColumn("_used", F.lit(0))
    marks = below.select("_base", (F.col("_u") - 1 - F.col("_r")).alias("_at"), F.lit(1).alias("_used"))
    merged = marks.unionByName(ranked, allowMissingColumns=True)
    merged = merged.withColumn("_item", 1 - F.col("_used"))
    counted = running(merged, Layout(("_base",), ("_at", "_item"), 1 << 10), {"_before": ("sum", "_used")})
    return counted.filter("_used = 0").withColumn("_index", F.col("_at") + 1 + F.coalesce("_before", F.lit(0)))


def audit_layout(files: DataFrame, staging: bool = False) -> DataFrame:
    """Project layout findings: missing folders, loose items, unstable names and, in a shared
    drive, video that must not be there. ``files(root, path)``, paths relative to the root."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    folders = files.select(
        "root",
        F.explode(F.array_compact(F.array(
            F.when(depth >= 1, F.get(parts, F.lit(0))),
            F.when(depth >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))),
        ))).alias("path"),
    ).distinct()
    wanted = F.array(
        *[F.struct(F.lit(p).alias("path"), F.lit("error").alias("severity"), F.lit("missing_directory").alias("code")) for p in K.LAYOUT_REQUIRED],
        *[F.struct(F.lit(p).alias("path"), F.lit("warning").alias("severity"), F.lit("missing_subdirectory").alias("code")) for p in K.LAYOUT_SUBDIRS],
    )
    required = files.select("root").distinct().select("root", F.inline(wanted))
    absent = required.join(folders, ["root", "path"], "left_anti")
    kind = classify_path("path")
    video = extension("path").isin(*K.LAYOUT_VIDEO_EXT) & F.lit(staging)
    finding = lambda sev, code: F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))
    issues = F.array_compact(F.array(
        F.when(kind["loose"], finding("warning", "loose_root_item")),
        F.when(kind["unstable"], finding("warning", "unstable_name")),
        F.when(video & (kind["hint"] == "raw"), finding("error", "raw_video_forbidden_in_drive"))
        .when(video & (kind["hint"] == "stock"), finding("error", "stock_video_forbidden_in_drive"))
        .when(video & (kind["hint"] == "none"), finding("error", "unclassified_video_forbidden_in_drive")),
    ))
    found = files.select("root", "path", F.inline(issues))
    return absent.select("root", "path", "severity", "code").unionByName(found)


def fit_tags(tags: Column | str, limit: int = 500) -> Column:
    """Longest prefix of the tag list whose cost stays within the limit, and what was cut."""
    t = F.col(tags) if isinstance(tags, str) else tags

    def add(acc: Column, x: Column) -> Column:
        cost = acc["cost"] + F.length(x) + F.when(acc["seen"] > 0, 1).otherwise(0) + F.when(x.contains(" "), 2).otherwise(0)
        fits = cost <= limit
        return F.struct(
            cost.alias("cost"), (acc["seen"] + 1).alias("seen"), F.when(fits, acc["seen"] + 1).otherwise(acc["kept"]).alias("kept")
        )

    start = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("seen"), F.lit(0).alias("kept"))
    kept = F.aggregate(t, start, add, lambda acc: acc["kept"])
    return F.struct(F.slice(t, 1, kept).alias("kept"), F.slice(t, kept + 1, F.size(t)).alias("cut"))


def tag_report(lists: DataFrame, key: str) -> DataFrame:
    """Count, text length, cost and repeats (ignoring case) of each tag list ``tags``."""
    base = lists.select(
        key, F.size("tags").alias("n_tags"), F.length(F.array_join("tags", ",")).alias("text_length"), tag_cost("tags").alias("cost"),
        (F.size("tags") - F.size(F.array_distinct(F.transform("tags", lambda x: F.lower(x))))).alias("repeats"),
    )
    return base


def black_segments(black: DataFrame, lengths: DataFrame, least: float = 0.15, margin: float = 0.4) -> DataFrame:
    """Pieces between black gaps, each taking up to ``margin`` (at most half) of the black around it."""
    ends = lengths.select("media_id", F.col("duration").alias("s"), F.col("duration").alias("e"))
    edges = black.select("media_id", "s", "e").unionByName(ends)
    near = neighbours(edges, Layout(("media_id",), ("s", "e"), 3600.0), lag={"_ps": "s", "_pe": "e"})
    prev = F.coalesce("_pe", F.lit(0.0))
    head = F.when(F.col("_pe").isNull(), 0.0).otherwise(F.least(F.lit(margin), (prev - F.col("_ps")) / 2))
    tail = F.least(F.lit(margin), (F.col("e") - F.col("s")) / 2)
    pieces = near.filter(F.col("s") - prev > least).select(
        "media_id", (prev - head).alias("a"), (F.col("s") + tail).alias("b")
    )
    return pieces.join(lengths, "media_id").select(
        "media_id", F.round(F.greatest(F.lit(0.0), "a"), 3).alias("s"), F.round(F.least("duration", "b"), 3).alias("e")
    )
