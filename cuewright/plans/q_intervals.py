"""Interval joins, as-of lookups, merging and time maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import intervals as iv
from cuewright.operators import levels as lv
from cuewright.operators.slices import Layout, timed
from cuewright.plans import bindings as B
from cuewright.plans.bindings import with_
from cuewright.plans.registry import query

EVENT_ORDER = timed("media_id", "s", "e", "event_id")


def _clicks(spark, d):
    return B.interval(spark, d).filter("kind = 'click'").select("media_id", "event_id", "s", "e")


def _others(spark, d):
    return B.interval(spark, d).filter("kind <> 'click'").select("media_id", "event_id", "s", "e")


CLICKS = """, click as (select media_id, event_id, s, e from "interval" where kind='click'),
  views as (select media_id, event_id, s, e from "interval" where kind<>'click') """


@query("jn0_interval_join", with_("word keep", """select w.media_id, w.seq, k.s as keep_s,
      round(least(w.e,k.e)-greatest(w.s,k.s),6) as overlap
    from word w join keep k on w.media_id=k.media_id and w.s<k.e and w.e>k.s where least(w.e,k.e)-greatest(w.s,k.s)>0"""))
def jn0(spark, d):
    pairs = iv.interval_join(B.word(spark, d), B.keep(spark, d))
    return pairs.select("media_id", "seq", F.col("b_s").alias("keep_s"), F.round("overlap", 6).alias("overlap"))


@query("jn1_kept", with_("word keep", """select w.media_id, w.seq, w.word from word w join keep k
    on w.media_id=k.media_id and w.s<k.e and w.e>k.s group by 1,2,3
    having round(sum(least(w.e,k.e)-greatest(w.s,k.s)),6) > 0.03::double"""))
def jn1(spark, d):
    return iv.kept(B.word(spark, d), B.keep(spark, d), ["seq"]).select("media_id", "seq", "word")


@query("jn2_text_in", with_("word keep", """select k.media_id, k.s, coalesce(string_agg(w.word,' ' order by w.seq),'') as text
    from keep k left join word w on w.media_id=k.media_id and w.s<k.e and w.e>k.s group by 1,2"""))
def jn2(spark, d):
    keep = B.keep(spark, d).withColumn("k", F.col("s"))
    return iv.text_in(keep, B.word(spark, d), ["k"]).select("media_id", "s", "text")


@query("jn3_point_in", with_("word keep", """select media_id, seq from word w where exists
    (select 1 from keep k where k.media_id=w.media_id and w.s>=k.s and w.s<k.e)"""))
def jn3(spark, d):
    return iv.point_in(B.word(spark, d), "s", B.keep(spark, d)).select("media_id", "seq")


@query("jn4_mid_word", with_("word keep", """select k.media_id, k.e as t, w.word, w.e as word_end from keep k join word w
    on w.media_id=k.media_id and k.e>w.s+0.05::double and k.e<w.e-0.05::double and w.e-k.e>0.08::double"""))
def jn4(spark, d):
    ends = B.keep(spark, d).select("media_id", F.col("e").alias("t"))
    return iv.mid_word(ends, B.word(spark, d), margin=0.05, tail=0.08)


@query("jn5_asof", with_("interval", CLICKS + """select event_id,
      (select round(max(v.e),2) from views v where v.media_id=c.media_id and v.e<=c.s+0.02::double) as cut_from,
      (select round(min(v.s),2) from views v where v.media_id=c.media_id and v.s>=c.e-0.02::double) as cut_to
    from click c"""))
def jn5(spark, d):
    around = iv.pause_around(_clicks(spark, d), _others(spark, d))
    return around.select("event_id", "cut_from", "cut_to")


@query("jn6_nearest", with_("interval", CLICKS + """, p as (select c.event_id, c.s as t, v.s, v.e, abs((v.s+v.e)/2-c.s) as dist,
      row_number() over (partition by c.event_id order by abs((v.s+v.e)/2-c.s), (v.s+v.e)/2, v.s) as rn
      from click c left join views v on v.media_id=c.media_id)
    select event_id, case when dist<=900 then s end as near_s, case when dist<=900 then e end as near_e from p where rn=1"""))
def jn6(spark, d):
    near = iv.nearest(_clicks(spark, d), "s", _others(spark, d), reach=900.0)
    return near.select("event_id", F.col("near.s").alias("near_s"), F.col("near.e").alias("near_e"))


@query("jn10_to_output", with_("word keep", """, k as (select *, coalesce(sum(e-s) over (partition by media_id order by s
      rows between unbounded preceding and 1 preceding),0) as off from keep)
    select w.media_id, w.seq, round(coalesce(max_by(k.off+least(w.s,k.e)-k.s, k.s),0),3) as out_t
    from word w left join k on k.media_id=w.media_id and k.s<=w.s group by 1,2"""))
def jn10(spark, d):
    return iv.to_output(B.word(spark, d), "s", B.keep(spark, d)).select("media_id", "seq", "out_t")


@query("jn11_retime", with_("keep", """, ev as (select media_id, unnest(range(0,cast(floor(max(e)) as bigint)+1,3))*1.0::double as t from keep group by media_id),
    o as (select *, coalesce(sum(e-s) over (partition by media_id order by s rows between unbounded preceding and 1 preceding),0) as off from keep),
    n as (select media_id, s, e, coalesce(sum(e-s) over (partition by media_id order by s rows between unbounded preceding and 1 preceding),0) as off
      from (select media_id, s+1.5::double as s, e-0.5::double as e from keep where s%24<12)),
    ends as (select media_id, oe, ne from (select media_id, sum(e-s) as oe from o group by 1) join (select media_id, sum(e-s) as ne from n group by 1) using (media_id)),
    src as (select ev.media_id, ev.t, max_by(o.s+ev.t-o.off, o.off) as x from ev left join o on o.media_id=ev.media_id and o.off<=ev.t group by 1,2),
    c as (select src.media_id, src.t, x, n.s, n.e, n.off,
        row_number() over (partition by src.media_id, src.t order by case when x>=n.s-1e-6::double and x<=n.e+1e-6::double then 0 else 1 end,
          least(abs(x-n.s),abs(x-n.e)), n.s) as rn from src join n on n.media_id=src.media_id)
    select c.media_id, t, case when t<=0 or t>oe+1 then t when t>=oe then round(ne+t-oe,2)
      when x>=s-1e-6::double and x<=e+1e-6::double then round(off+x-s,2)
      when abs(x-s)<abs(x-e) then round(off,2) else round(off+e-s,2) end as new_t
    from c join ends using (media_id) where rn=1"""))
def jn11(spark, d):
    old = B.keep(spark, d)
    new = old.filter("s % 24 < 12").select("media_id", (F.col("s") + 1.5).alias("s"), (F.col("e") - F.lit(0.5)).alias("e"))
    ends = old.groupBy("media_id").agg(F.floor(F.max("e")).alias("_end"))
    ev = ends.select("media_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_end"), F.lit(3).cast("bigint"))).alias("t")).withColumn("t", F.col("t").cast("double"))
    return iv.retime(ev, "t", old, new)


@query("jn22_unpaired_events", with_("interval", CLICKS + """select c.event_id, c.s as t from click c where not exists
    (select 1 from views v where v.media_id=c.media_id and abs(v.s-c.s)<120)"""))
def jn22(spark, d):
    return iv.unpaired_events(
        _clicks(spark, d).select("media_id", "event_id", F.col("s").alias("t")),
        _others(spark, d).select("media_id", F.col("s").alias("t")), tol=120.0,
    ).select("event_id", "t")


@query("jn23_event_conflicts", with_("interval", CLICKS + """, m as (select c.event_id, c.s as t, min(abs(v.s-c.s)) as dist from click c
      join views v on v.media_id=c.media_id group by 1,2)
    select event_id, t, dist from m where dist>5 and dist<120"""))
def jn23(spark, d):
    return iv.event_conflicts(
        _clicks(spark, d).select("media_id", "event_id", F.col("s").alias("t")),
        _others(spark, d).select("media_id", F.col("s").alias("t")), low=5.0, high=120.0,
    ).select("event_id", "t", "dist")


@query("jn31_voice_without_word", with_("interval", CLICKS + """, c as (select c.event_id, c.s, c.e, coalesce(sum(case when v.s is not null then least(c.e,v.e)-greatest(c.s,v.s) end),0) as cov
      from click c left join views v on v.media_id=c.media_id and v.s<c.e and v.e>c.s group by 1,2,3)
    select event_id, round(cov/(e-s),6) as coverage from c where e-s>=0.2::double and round(cov/(e-s),6)<0.25::double"""))
def jn31(spark, d):
    return iv.voice_without_word(_clicks(spark, d), _others(spark, d), ["event_id"]).select("event_id", "coverage")


@query("win1_runs", with_("level", """, g as (select media_id, frame, db, frame-row_number() over (partition by media_id order by frame) as run
      from level where db>-40)
    select media_id, min(frame) as f0, max(frame)+1 as f1, count(*) as frames, max(db) as peak from g group by media_id, run having count(*)>=2"""))
def win1(spark, d):
    return lv.runs(B.level(spark, d), F.col("db") > -40, 2, measures={"peak": F.max("db")})


@query("win2_runs_hysteresis", with_("level", """, l as (select *, frame-lag(frame) over (partition by media_id order by frame) as gap from level where db>-39),
    g as (select *, sum(case when gap is null or gap>2 then 1 else 0 end) over (partition by media_id order by frame) as run from l)
    select media_id, min(frame) filter (db>-20) as f0, max(frame)+1 as f1 from g group by media_id, run
    having min(frame) filter (db>-20) is not null and max(frame)+1-min(frame) filter (db>-20)>=3"""))
def win2(spark, d):
    return lv.runs_hysteresis(B.level(spark, d), F.col("db") > -20, F.col("db") > -39, min_frames=3, max_gap=1)


def _merged(cond: str) -> str:
    return with_("interval", f""", r as (select *, max(e) over (partition by media_id order by s,e,event_id rows between unbounded preceding and 1 preceding) as reach from "interval"),
    g as (select *, sum(case when reach is null or not ({cond}) then 1 else 0 end) over (partition by media_id order by s,e,event_id) as island from r)
    select media_id, min(s) as s, max(e) as e, count(*) as parts from g group by media_id, island""")


@query("win3_merge_gaps", _merged("s-reach<600"))
def win3(spark, d):
    return iv.merge_gaps(B.interval(spark, d), 600.0, EVENT_ORDER)


@query("win5_merge_overlaps", _merged("s<=reach+0.05::double"))
def win5(spark, d):
    return iv.merge_overlaps(B.interval(spark, d), 0.05, EVENT_ORDER)


@query("win4_offsets", with_("keep", """select media_id, s, e, coalesce(sum(e-s) over (partition by media_id order by s
    rows between unbounded preceding and 1 preceding),0) as off from keep"""))
def win4(spark, d):
    return iv.offsets(B.keep(spark, d))


@query("win6_complement", with_("interval", """, b as (select media_id, min(s)-10 as lo, max(s)+100 as hi from "interval" group by 1),
    m as (select media_id, s, case when event_id%50=7 then cast('inf' as double) else e end as e from "interval"
      union all select media_id, lo, lo from b union all select media_id, hi, hi from b),
    r as (select media_id, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) as s, s as e from m)
    select media_id, greatest(r.s,lo) as s, least(r.e,hi) as e from r join b using (media_id)
    where r.s is not null and round(least(r.e,hi)-greatest(r.s,lo),6)>0.05::double"""))
def win6(spark, d):
    cuts = B.interval(spark, d).withColumn("e", F.when(F.col("event_id") % 50 != 7, F.col("e")))
    bounds = cuts.groupBy("media_id").agg((F.min("s") - 10).alias("lo"), (F.max("s") + 100).alias("hi"))
    return iv.complement(cuts, bounds, tiny=0.05)


@query("win14_enforce_gap", with_("interval", """, r as (select *, row_number() over (partition by media_id order by s,e,event_id)-1 as i from "interval")
    select event_id, round(max(s-i*300.0::double) over (partition by media_id order by i)+i*300.0::double,6) as s_fixed from r"""))
def win14(spark, d):
    out = iv.enforce_gap(B.interval(spark, d), 300.0, EVENT_ORDER)
    return out.select("event_id", F.round("s_fixed", 6).alias("s_fixed"))


@query("win15_clip_to_next", with_("interval", """select event_id, s, least(e, lead(s) over (partition by media_id order by s,e,event_id)) as e from "interval" """))
def win15(spark, d):
    return iv.clip_to_next(B.interval(spark, d), EVENT_ORDER).select("event_id", "s", "e")


@query("set4_split_at", with_("keep word", """, m as (select media_id, s as k, unnest([s,e]) as t, s, e from keep
      union select k.media_id, k.s, w.s, k.s, k.e from keep k join word w on w.media_id=k.media_id and w.s>k.s+0.04::double and w.s<k.e-0.04::double),
    d as (select distinct media_id, k, t from m), p as (select media_id, k, t as s, lead(t) over (partition by media_id, k order by t) as e from d)
    select media_id, k, s, e from p where e is not null"""))
def set4(spark, d):
    keep = B.keep(spark, d).withColumn("k", F.col("s"))
    points = B.word(spark, d).select("media_id", F.col("s").alias("t"))
    return iv.split_at(keep, points, guard=0.04, row=["k"])


@query("ag2_clip_totals", with_("keep", """select media_id, sum(e-s) as kept, count(*)-1 as splices, sum(e-s)+0.5::double as final_s from keep group by 1"""))
def ag2(spark, d):
    return iv.totals(B.keep(spark, d), tail_hold=0.5)
