"""Social-post analytics: rates, typical posts, rankings, cadence, patterns, calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.quantiles import quantiles
from cuewright.operators.slices import top_rows


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def post_rates(posts: DataFrame) -> DataFrame:
    """Rates per post; a post that reached nobody has rates of 0. Rates need their columns."""
    c, have = F.col, set(posts.columns)
    acts = c("likes") + c("comments") + c("saves") + c("shares")
    out = posts.withColumn("engagement", _rate(acts, c("reach")))
    out = out.withColumn("save_rate", _rate(c("saves"), c("reach"))).withColumn("share_rate", _rate(c("shares"), c("reach")))
    if "views" in have:
        out = out.withColumn("view_engagement", _rate(acts, c("views")))
        if "follows" in have:
            out = out.withColumn("follows_per_1000_views", _rate(c("follows") * 1000, c("views")))
    if "follows" in have:
        out = out.withColumn("follows_per_1000_reach", _rate(c("follows") * 1000, c("reach")))
    return out


def funnel(metrics: DataFrame, reach: str, visits: str, follows: str, clicks: str, key=("client", "month")) -> DataFrame:
    """Passages of the funnel per account and month: visits/reach, follows/visits, clicks/visits."""
    value = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    wide = metrics.groupBy(*key).agg(
        value(reach).alias("_r"), value(visits).alias("_v"), value(follows).alias("_f"), value(clicks).alias("_c")
    )
    return wide.select(
        *key,
        F.try_divide("_v", "_r").alias("visit_rate"),
        F.try_divide("_f", "_v").alias("follow_rate"),
        F.try_divide("_c", "_v").alias("click_rate"),
    )


def drop_top_posts(posts: DataFrame, account: Sequence[str], measure: str, n: int = 1) -> DataFrame:
    """Posts without the ``n`` biggest of each account."""
    top = top_rows(posts.select(*account, "post_id", measure), account, [F.col(measure).desc(), F.col("post_id")], n)
    return posts.join(top.select(*account, "post_id"), [*account, "post_id"], "left_anti")


def typical_post(posts: DataFrame, by: Sequence[str], measure: str = "reach", account: Sequence[str] = ("platform",), drop_top: int = 1) -> DataFrame:
    """Median of a measure per group, over all posts and without each account's biggest."""
    everything = quantiles(posts, by, {"median_all": (measure, 0.5)})
    rest = quantiles(drop_top_posts(posts, account, measure, drop_top), by, {"median_rest": (measure, 0.5)})
    return everything.join(rest, list(by), "left")


def rank_posts(posts: DataFrame, metric: str, n: int = 5, floor: int = 500, asc: bool = False) -> DataFrame:
    """Best (or worst) ``n`` posts per platform among those that reached at least ``floor``."""
    order = F.col(metric).asc() if asc else F.col(metric).desc()
    return top_rows(posts.filter(F.col("reach") >= floor), ["platform"], [order, F.col("post_id")], n)


def cadence(posts: DataFrame, formats: Sequence[str], key: Sequence[str] = ("platform",)) -> DataFrame:
    """Posts per ISO year, ISO week and format."""
    year = F.extract(F.lit("YEAROFWEEK"), F.col("published_at")).alias("iso_year")
    week = F.weekofyear("published_at").alias("week")
    counts = [F.count_if(F.col("format") == f).alias(f) for f in formats]
    return posts.groupBy(*key, year, week).agg(*counts)


def evolution(metrics: DataFrame, months: Sequence[str], order: Sequence[str] = (), key: Sequence[str] = ("client",)) -> DataFrame:
    """Indicator rows against month columns, in the order of ``order`` when given."""
    cells = [F.max(F.when(F.col("month") == m, F.col("value"))).alias(m) for m in months]
    wide = metrics.filter(F.col("month").isin(*months)).groupBy(*key, "metric").agg(*cells)
    if not order:
        return wide
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("metric"))
    return wide.filter(rank > 0).withColumn("row", rank.cast("int")).orderBy(*key, "row")


def patterns(posts: DataFrame, dims: Sequence[str], measure: str, account: Sequence[str] = ("platform",)) -> DataFrame:
    """Is a trait consistently above the account median (three posts in two weeks) or isolated?"""
    mid = quantiles(posts, account, {"_mid": (measure, 0.5)})
    above = posts.join(mid, list(account)).filter(F.col(measure) > F.col("_mid"))
    weekly = above.groupBy(*account, *dims, F.date_trunc("week", "published_at").alias("_w")).agg(F.count("*").alias("_n"))
    total = weekly.groupBy(*account, *dims).agg(F.sum("_n").alias("posts"), F.count("*").alias("weeks"))
    steady = (F.col("posts") >= 3) & (F.col("weeks") >= 2)
    return total.withColumn("pattern", F.when(steady, "consistent").otherwise("isolated"))


def expand_calendar(
    cuts: DataFrame, platforms: Mapping[str, tuple[str, str]], success: Mapping[tuple[str, str], str]
) -> DataFrame:
    """One calendar row per cut and platform (platform -> format, call to action), with the
    success measure of the cut's funnel stage on that platform."""
    offers = F.array(
        *[F.struct(F.lit(p).alias("platform"), F.lit(f).alias("format"), F.lit(cta).alias("cta")) for p, (f, cta) in platforms.items()]
    )
    goal = F.create_map(*[x for (stage, p), text in success.items() for x in (F.lit(f"{stage}|{p}"), F.lit(text))])
    wide = cuts.withColumn("_p", F.explode(offers))
    others = [c for c in cuts.columns if c != "structure"]
    rows = [*others, F.col("_p.platform").alias("platform"), F.col("_p.format").alias("format"), F.col("_p.cta").alias("cta"),
            F.try_element_at(goal, F.concat_ws("|", "funnel", "_p.platform")).alias("metric")]
    if "structure" in cuts.columns:
        rows.append(F.array_append("structure", F.lit("CTA")).alias("structure"))
    return wide.select(*rows)


def build_calendar(cuts: DataFrame, episodes: DataFrame, backup: DataFrame) -> DataFrame:
    """Cuts, episodes and reserve rows as one calendar in publishing order."""
    parts = [p.withColumn("branch", F.lit(b)) for p, b in ((cuts, "cut"), (episodes, "episode"), (backup, "backup"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.orderBy(F.col("branch") == "backup", "date", "hour", "platform")


def check_capacity(calendar: DataFrame, per_week: int = 5) -> DataFrame:
    """ISO weeks over capacity and posts on a weekend."""
    weekly = calendar.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("int").alias("iso_year"), F.weekofyear("date").alias("week")).agg(
        F.count("*").alias("posts"), F.count_if(F.weekday("date") >= 5).alias("weekend_posts")
    )
    return weekly.filter((F.col("posts") > per_week) | (F.col("weekend_posts") > 0)).withColumn(
        "over_capacity", F.col("posts") > per_week
    )


def calendar_mix(calendar: DataFrame, by: Sequence[str] = ("funnel", "pillar")) -> DataFrame:
    """Posts per funnel stage and per pillar."""
    sets = [calendar.groupBy(F.lit(b).alias("dimension"), F.col(b).alias("value")).agg(F.count("*").alias("posts")) for b in by]
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out
