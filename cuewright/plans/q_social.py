"""Social analytics over posts and account metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import social as so
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.registry import query
from cuewright.sources import sinks

_RATES = """, rates as (select *, coalesce((likes+comments+saves+shares)/nullif(reach,0)::double,0) as engagement,
    coalesce(saves/nullif(reach,0)::double,0) as save_rate, coalesce(shares/nullif(reach,0)::double,0) as share_rate from post) """


@query("ag3_post_rates", with_("post", _RATES + "select platform, post_id, engagement, save_rate, share_rate from rates"))
def ag3(spark, d):
    return so.post_rates(B.post(spark, d)).select("platform", "post_id", "engagement", "save_rate", "share_rate")


@query("ag4_funnel", with_("account_metric", """, w as (select client, month, max(value) filter (metric='1-URGENT') as r, max(value) filter (metric='2-HIGH') as v,
      max(value) filter (metric='3-MEDIUM') as f, max(value) filter (metric='5-LOW') as c from account_metric group by 1,2)
    select client, month, v/nullif(r,0) as visit_rate, f/nullif(v,0) as follow_rate, c/nullif(v,0) as click_rate from w"""))
def ag4(spark, d):
    return so.funnel(B.account_metric(spark, d), "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("ag5_typical_post", with_("post", """, t as (select *, row_number() over (partition by platform order by reach desc, post_id) as rn from post),
    a as (select platform, format, quantile_cont(reach,0.5) as median_all from t group by 1,2),
    b as (select platform, format, quantile_cont(reach,0.5) as median_rest from t where rn>1 group by 1,2)
    select a.platform, a.format, median_all, median_rest from a left join b using (platform, format)"""))
def ag5(spark, d):
    return so.typical_post(B.post(spark, d), ["platform", "format"])


@query("top1_rank_posts", with_("post", _RATES + """select platform, post_id, engagement, rank from (select *, row_number() over (partition by platform order by engagement desc, post_id) as rank
    from rates where reach>=500) where rank<=5"""))
def top1(spark, d):
    ranked = so.rank_posts(so.post_rates(B.post(spark, d)), "engagement")
    return ranked.select("platform", "post_id", "engagement", "rank")


@query("ag6_cadence", with_("post", """select platform, cast(isoyear(published_at) as int) as iso_year, weekofyear(published_at) as week, count(*) filter (format='F') as "F", count(*) filter (format='O') as "O",
    count(*) filter (format='P') as "P" from post group by 1,2,3"""))
def ag6(spark, d):
    return so.cadence(B.post(spark, d), ["F", "O", "P"])


_MONTHS = [f"{y}-{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]
_ROWS = ["5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("ag7_evolution", with_("account_metric", "select client, metric, list_position(['5-LOW','1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED'],metric) as row, "
       + ", ".join(f"max(value) filter (month='{m}') as \"{m}\"" for m in _MONTHS)
       + " from account_metric group by 1,2,3"))
def ag7(spark, d):
    return so.evolution(B.account_metric(spark, d), _MONTHS, _ROWS)


@query("ag8_patterns", with_("post", _RATES + """, m as (select platform, quantile_cont(engagement,0.5) as mid from rates group by 1),
    w as (select r.platform, format, likes%5 as style, date_trunc('week',published_at) as w, count(*) as n from rates r join m using (platform) where engagement>mid group by 1,2,3,4),
    t as (select platform, format, style, cast(sum(n) as bigint) as posts, count(*) as weeks from w group by 1,2,3)
    select platform, format, style, posts, weeks, case when posts>=3 and weeks>=2 then 'consistent' else 'isolated' end as pattern from t"""))
def ag8(spark, d):
    posts = so.post_rates(B.post(spark, d)).withColumn("style", F.col("likes") % 5)
    return so.patterns(posts, ["format", "style"], "engagement")


PLATFORMS = {"Instagram": ("Reels", "link in bio"), "TikTok": ("Video", "text on screen"), "Shorts": ("Short", "related video")}
SUCCESS = {("top", "Instagram"): "views", ("mid", "Instagram"): "saves", ("top", "TikTok"): "views", ("end", "TikTok"): "visits", ("mid", "Shorts"): "watched"}


def calendar_cuts(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "12:00").otherwise("19:00").alias("hour"),
        F.col("o_orderkey").alias("item"), F.when(status == "F", "top").when(status == "O", "mid").otherwise("end").alias("funnel"),
        F.col("o_orderpriority").alias("pillar"), F.array(F.lit("hook"), F.col("o_orderpriority")).alias("structure"),
    )


CUTS = """cuts as (select cast(o_orderdate as date) as date, case when o_orderkey%2=0 then '12:00' else '19:00' end as hour, o_orderkey as item,
    case o_orderstatus when 'F' then 'top' when 'O' then 'mid' else 'end' end as funnel, o_orderpriority as pillar from orders),
  offers(platform, format, cta) as (values ('Instagram','Reels','link in bio'),('TikTok','Video','text on screen'),('Shorts','Short','related video')),
  goals(funnel, platform, metric) as (values ('top','Instagram','views'),('mid','Instagram','saves'),('top','TikTok','views'),('end','TikTok','visits'),('mid','Shorts','watched')),
  cal as (select c.*, o.platform, o.format, o.cta, g.metric from cuts c, offers o left join goals g on g.funnel=c.funnel and g.platform=o.platform) """


@query("jn29_expand_calendar", f"with {CUTS} select date, hour, item, funnel, pillar, platform, format, cta, metric, 'hook|'||pillar||'|CTA' as structure from cal")
def jn29(spark, d):
    cal = so.expand_calendar(calendar_cuts(spark, d), PLATFORMS, SUCCESS)
    return cal.withColumn("structure", F.array_join("structure", "|"))


@query("set1_build_calendar", f"""with {CUTS} select date, hour, item, platform, format, 'cut' as branch from cal where item%3<>0
    union all select date, '19:00', item, unnest(['YouTube','Spotify']), 'Full episode', 'episode' from cuts where item%10=0
    union all select date, '12:00', item, platform, format, 'backup' from cal where item%3=0""")
def set1(spark, d):
    cuts = calendar_cuts(spark, d)
    main = so.expand_calendar(cuts.filter("item % 3 <> 0"), PLATFORMS, SUCCESS)
    backup = so.expand_calendar(cuts.filter("item % 3 = 0"), PLATFORMS, SUCCESS).withColumn("hour", F.lit("12:00"))
    shows = cuts.filter("item % 10 = 0").select(
        "date", F.lit("19:00").alias("hour"), "item", F.explode(F.array(F.lit("YouTube"), F.lit("Spotify"))).alias("platform"),
        F.lit("Full episode").alias("format"),
    )
    return so.build_calendar(main, shows, backup).select("date", "hour", "item", "platform", "format", "branch")


@query("ag23_check_capacity", f"""with {CUTS} select * from (select cast(isoyear(date) as int) as iso_year, weekofyear(date) as week, count(*) as posts, count(*) filter (isodow(date)>=6) as weekend_posts,
    count(*)>5 as over_capacity from cuts group by 1,2) where over_capacity or weekend_posts>0""")
def ag23(spark, d):
    return so.check_capacity(calendar_cuts(spark, d))


@query("ag24_calendar_mix", f"""with {CUTS} select 'funnel' as dimension, funnel as value, count(*) as posts from cuts group by 2
    union all select 'pillar', pillar, count(*) from cuts group by 2""")
def ag24(spark, d):
    return so.calendar_mix(calendar_cuts(spark, d))


@query("snk5_calendar_sheet", f"""with {CUTS} select strftime(date,'%Y-%m-%d') as date, hour, platform, format, pillar, funnel, 'hook'||chr(10)||pillar||chr(10)||'CTA' as structure, cta, coalesce(metric,'') as metric,
    '' as status, '' as owner, '' as link from cal""")
def snk5(spark, d):
    return sinks.calendar_sheet(so.expand_calendar(calendar_cuts(spark, d), PLATFORMS, SUCCESS))
