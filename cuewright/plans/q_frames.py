"""Frame-level queries over levels, frame differences, faces and photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import frames as fr
from cuewright.operators.levels import runs
from cuewright.operators.slices import Layout
from cuewright.plans import bindings as B
from cuewright.plans.bindings import with_
from cuewright.plans.registry import query
from cuewright.session import written


def _rec(names: str, text: str) -> str:
    return with_(names, text).replace("with", "with recursive", 1)


# Chain over c(media_id, frame) with nx(media_id, frame, nxt): frames on the chain.
_CUTS = """, c as (select media_id, frame from frame_diff where diff>=50),
    nx as (select a.media_id, a.frame, min(b.frame) as nxt from c a left join c b on b.media_id=a.media_id and b.frame>a.frame+3 group by 1,2),
    ch as (select media_id, min(frame) as frame from c group by 1 union all select ch.media_id, nx.nxt from ch join nx using (media_id, frame) where nx.nxt is not null)"""
_SHOTS = _CUTS + """, span as (select media_id, max(frame)+1 as ends from frame_diff group by 1),
    ed as (select media_id, frame from ch where frame>0 union select media_id, 0 from span),
    shot as (select media_id, frame as f0, coalesce(lead(frame) over (partition by media_id order by frame), ends) as f1 from ed join span using (media_id))"""


def _shots(spark, d):
    return fr.shots(written(B.frame_diff(spark, d)), 50.0, 3)


@query("win16_debounce", _rec("frame_diff", _CUTS + " select media_id, frame from ch"))
def win16(spark, d):
    return fr.debounce(B.frame_diff(spark, d).filter("diff >= 50").select("media_id", "frame"), 3)


@query("win17_dedup_onsets", with_("frame_diff", """, c as (select media_id, frame, frame-lag(frame) over (partition by media_id order by frame) as gap from frame_diff where diff>=40)
    select media_id, frame from c where gap is null or gap>3"""))
def win17(spark, d):
    return fr.dedup_onsets(B.frame_diff(spark, d).filter("diff >= 40").select("media_id", "frame"), 3)


@query("win18_shots", _rec("frame_diff", _SHOTS + " select media_id, f0, f1 from shot"))
def win18(spark, d):
    return _shots(spark, d)


@query("ag17_shot_stats", _rec("frame_diff", _SHOTS + """ select media_id, count(*) as shots, round(quantile_cont((f1-f0)/30.0::double,0.5),6) as median_s,
    round((count(*)-1)/(sum(f1-f0)/30.0::double)*10,6) as cuts_per_10s from shot group by 1"""))
def ag17(spark, d):
    return fr.shot_stats(_shots(spark, d))


@query("flt12_short_shots", _rec("frame_diff", _SHOTS + """, dur as (select media_id, max(f1)/30.0::double as d from shot group by 1)
    select media_id, f0, f1 from shot join dur using (media_id) where f0/30.0::double>0.5 and f1/30.0::double<d-0.5 and round(f1/30.0::double-f0/30.0::double,6)<0.4::double"""))
def flt12(spark, d):
    return fr.short_shots(_shots(spark, d), min_s=0.4)


@query("win19_stray_frames", with_("frame_diff", """, p as (select media_id, frame, lead(frame) over (partition by media_id order by frame)-frame as frames from frame_diff where diff>=50)
    select media_id, frame, frames from p where frames<=4 and not (frame%20<17.5::double)"""))
def win19(spark, d):
    diff = B.frame_diff(spark, d)
    mix = diff.select("media_id", "frame", (F.col("frame") % 20).cast("double").alias("mix"))
    return fr.stray_frames(diff.withColumn("diff", F.col("diff") - 15), mix, 35.0, 4)


@query("ag18_cadence_ratio", with_("frame_diff", "select media_id, avg(case when diff-20>0 then 1.0::double else 0 end) as unique_ratio from frame_diff group by 1"))
def ag18(spark, d):
    return fr.cadence_ratio(B.frame_diff(spark, d).withColumn("diff", F.col("diff") - 20))


@query("win20_rolling_median", with_("level", "select media_id, frame, quantile_cont(db,0.5) over (partition by media_id order by frame range between 5 preceding and 5 following) as median from level"))
def win20(spark, d):
    return fr.rolling_median(B.level(spark, d), "db", 5).select("media_id", "frame", "median")


@query("win22_moving_avg", with_("level", "select media_id, frame, round(sum(db) over (partition by media_id order by frame range between 25 preceding and 24 following)/50,6) as avg from level"))
def win22(spark, d):
    return fr.moving_avg(B.level(spark, d), "db", 50).select("media_id", "frame", F.round("avg", 6).alias("avg"))


@query("win23_peaks", with_("level", """, b as (select *, quantile_cont(db,0.5) over (partition by media_id order by frame range between 40 preceding and 39 following) as base,
      lag(db) over (partition by media_id order by frame) as p, lead(db) over (partition by media_id order by frame) as n from level)
    select media_id, frame, base from b where db>=p and db>=n and db-base>=18"""))
def win23(spark, d):
    return fr.peaks(B.level(spark, d), 18.0, 40).select("media_id", "frame", "base")


_ONSET = """select media_id, frame from (select *, coalesce(max(db) over (partition by media_id order by frame range between {g} preceding and 1 preceding)<-25,true) as still,
      count(*) filter (db>-25) over (partition by media_id order by frame range between current row and 7 following)>=5 as steady,
      max(db) over (partition by media_id order by frame range between current row and 9 following)>-11 as burst from level) where db>-25 and still and (steady or burst)"""


@query("win24_onsets", with_("level", _ONSET.format(g=2)))
def win24(spark, d):
    return fr.onsets(B.level(spark, d), 2, -25.0, -11.0).select("media_id", "frame")


def _level(spark, d):
    """Level frames that a query reads more than once, placed once."""
    return written(B.level(spark, d))


def _spoken(level):
    """Words as the recogniser might time them over the level frames of each recording."""
    return level.select("media_id", F.col("frame").alias("seq"), F.round(F.col("frame") * 0.01, 2).alias("s"), F.round(F.col("frame") * 0.01 + 0.3, 2).alias("e"))


_SPOKEN = """, spoken as (select media_id, frame as seq, round(frame*0.01::double,2) as s, round(frame*0.01::double+0.3::double,2) as e from level)"""


@query("win25_word_onset", with_("level", _SPOKEN + """, on6 as (""" + _ONSET.format(g=6).replace("-25", "-40").replace("-11", "-30") + """),
    on25 as (""" + _ONSET.format(g=25).replace("-25", "-40").replace("-11", "-30") + """),
    w as (select *, cast(floor(s/0.01::double) as bigint) as i0, cast(floor((e+0.1::double)/0.01::double) as bigint) as i1 from spoken),
    m as (select media_id, frame, avg(db) over (partition by media_id order by frame range between current row and 7 following) as m from level),
    c as (select w.*, m.m, (select arg_min(frame, (abs(frame-i0), frame)) from on6 where on6.media_id=w.media_id and frame>=6 and frame between i0-15 and i0+15) as near,
      (select min(frame) from on6 where on6.media_id=w.media_id and frame>=6 and frame>=i0) as nxt, (select min(frame) from on25 where on25.media_id=w.media_id and frame>=i0+25) as far
      from w left join m on m.media_id=w.media_id and m.frame=w.i0)
    select media_id, seq, round(coalesce(near, case when m<-40 and nxt<i1 then nxt end, case when not coalesce(m<-40,false) and far<i1 then far end)*0.01::double,3) as onset from c"""))
def win25(spark, d):
    level = _level(spark, d)
    return fr.word_onset(_spoken(level), level).select("media_id", "seq", "onset")


@query("win25_word_offset", with_("level", _SPOKEN + """, calm as (select media_id, frame from (select *, max(db) over (partition by media_id order by frame range between current row and 3 following) as m from level) where m<-28)
    select media_id, seq, least(e+2.0::double, coalesce((select min(frame) from calm where calm.media_id=w.media_id and frame>=cast(floor(e/0.01::double) as bigint))*0.01::double, e+2.0::double)) as speech_end from spoken w"""))
def win25b(spark, d):
    level = _level(spark, d)
    return fr.word_offset(_spoken(level), level, F.col("e") + 2.0, quiet=-28.0, still=4).select("media_id", "seq", "speech_end")


@query("jn7_snap_quietest", with_("level", _SPOKEN + """ select b.media_id, seq, coalesce(round(arg_min(l.frame,(l.db,l.frame))*0.01::double,3), any_value(s)) as snapped from spoken b
    left join level l on l.media_id=b.media_id and l.frame between greatest(round_even(s/0.01::double,0)-16,0) and round_even(s/0.01::double,0)+16 group by 1,2"""))
def jn7(spark, d):
    level = _level(spark, d)
    cuts = _spoken(level).withColumn("t", F.col("s"))
    return fr.snap_quietest(cuts, level, ["seq"]).select("media_id", "seq", "snapped")


_RUNS = """, g as (select media_id, frame, frame-row_number() over (partition by media_id order by frame) as run from level where db<-24),
    sil as (select media_id, round(min(frame)*0.05::double,3) as s, round((max(frame)+1)*0.05::double,3) as e from g group by media_id, run having count(*)>=3),
    bnd as (select media_id, frame as seq, round(frame*0.05::double,3) as t from level)"""


def _silences(level):
    found = runs(level, F.col("db") < -24, 3)
    return found.select("media_id", F.round(F.col("f0") * 0.05, 3).alias("s"), F.round(F.col("f1") * 0.05, 3).alias("e"))


def _boundaries(level):
    return level.select("media_id", F.col("frame").alias("seq"), F.round(F.col("frame") * 0.05, 3).alias("t"))


@query("jn8_snap_silence", with_("level", _RUNS + """, p as (select b.media_id, b.seq, b.t, s.s, round(least(s.e, s.s+0.12::double),3) as c from bnd b join sil s on s.media_id=b.media_id
      and round(s.s-0.25::double,6)<=t and t<=round(s.e+0.25::double,6))
    select b.media_id, b.seq, coalesce(arg_min(c,(round(abs(c-p.t),6),p.s)), any_value(b.t)) as snapped from bnd b left join p on p.media_id=b.media_id and p.seq=b.seq group by 1,2"""))
def jn8(spark, d):
    level = _level(spark, d)
    return fr.snap_silence(_boundaries(level), _silences(level), ["seq"], "start").select("media_id", "seq", "snapped")


@query("jn9_place_in_pause", with_("level", _RUNS + """, p as (select b.media_id, b.seq, b.t, round(greatest(s.s,floor((t-0.65::double)*100)/100),3) as r0, round(least(s.e,floor((t+0.65::double)*100)/100),3) as r1 from bnd b join sil s on s.media_id=b.media_id
      and s.s<t+0.65::double and s.e>t-0.65::double),
    q as (select *, case when r1>=t-0.02::double and r0<=t+0.35::double then 0 when r1>=t-0.10::double and r1<t then 1 end as tier,
      case when r0<=t+0.02::double and r1>=t then 0 else 1 end as pr, round(abs(r0-t),6) as dd from p),
    x as (select *, row_number() over (partition by media_id, seq order by tier, pr, dd, r0, r1) as rn from q where tier is not null),
    y as (select *, r0+least(case when seq%2=0 then 0.12::double else 0.03::double end+0.02::double, (r1-r0)*0.6::double) as t2 from x where rn=1)
    select b.media_id, b.seq, round(coalesce(case when r0<=y.t and y.t<=r1 then least(greatest(y.t,t2),r1-0.02::double) else t2 end, b.t),3) as placed, case when y.r0 is null then 'in_speech' else 'pause' end as place
    from bnd b left join y on y.media_id=b.media_id and y.seq=b.seq"""))
def jn9(spark, d):
    level = _level(spark, d)
    return fr.place_in_pause(_boundaries(level), _silences(level), ["seq"], "end", last=F.col("seq") % 2 == 0).select("media_id", "seq", "placed", "place")


@query("win26_snap_rise", with_("level", _SPOKEN + """, w as (select *, greatest(1, cast(floor((s-0.10::double)*100+1e-6::double) as bigint)) as i0, cast(floor((s+0.08::double)*100+1e-6::double) as bigint) as i1 from spoken),
    st as (select w.media_id, w.seq, quantile_cont(l.db,0.1) filter (l.frame>=greatest(w.i0-30,0) and l.frame<w.i1+30) as lo, max(l.db) filter (l.frame>=w.i0 and l.frame<w.i1+25) as hi from w join level l on l.media_id=w.media_id and l.frame between w.i0-30 and w.i1+30 group by 1,2),
    x as (select w.media_id, w.seq, min(b.frame) as f from w join st using (media_id, seq) join level b on b.media_id=w.media_id and b.frame>w.i0 and b.frame<=w.i1 join level a on a.media_id=b.media_id and a.frame=b.frame-1
      where b.db>=lo+(hi-lo)*0.3::double and a.db<lo+(hi-lo)*0.3::double group by 1,2)
    select w.media_id, w.seq, coalesce(round((f-1)/100.0::double,3), s) as rise from w left join x using (media_id, seq)"""))
def win26(spark, d):
    level = _level(spark, d)
    return fr.snap_rise(_spoken(level), level, ["seq"]).select("media_id", "seq", "rise")


_NEAR = """, b2 as (select media_id, frame as seq, round(frame*0.02::double,2) as t from level),
    f as (select b.media_id, b.seq, b.t, l.frame, l.frame*0.02::double as tt, db, lead(db,1) over w as d1, lead(db,2) over w as d2, lag(db,1) over w as p1, lag(db,2) over w as p2, row_number() over w as i
      from b2 b join level l on l.media_id=b.media_id and l.frame between greatest(floor((t-1.2::double)/0.02::double+1e-6::double),0) and floor((t+1.2::double)/0.02::double+1e-6::double)
      window w as (partition by b.media_id, b.seq order by l.frame))"""


def _cut_points(level):
    return level.select("media_id", F.col("frame").alias("seq"), F.round(F.col("frame") * 0.02, 2).alias("t"))


@query("win27_splice_out", with_("level", _NEAR + """, v as (select media_id, seq, max(tt) filter (db>-35 and tt<=t+0.1::double+1e-6::double) as v from f group by 1,2),
    s as (select f.media_id, f.seq, v, coalesce(round(min(tt) filter (tt>v and db<-35 and d1<-35)+0.02::double,2), round(v+0.12::double,2)) as sh from f join v using (media_id, seq) group by 1,2,3),
    l as (select f.media_id, f.seq, sh, coalesce(round(min(tt) filter (tt>sh and db>-20 and d1>-20 and d2>-20)-0.05::double,2), sh) as lo from f join s using (media_id, seq) group by 1,2,3)
    select b2.media_id, b2.seq, coalesce(case when round(lo-sh,6)<=0.3::double then lo else sh end, t) as suggested from b2 left join l using (media_id, seq)"""))
def win27(spark, d):
    level = _level(spark, d)
    return fr.suggest_splice(_cut_points(level), level, ["seq"], "out").select("media_id", "seq", "suggested")


@query("win27_splice_in", with_("level", _NEAR + """, x as (select *, row_number() over (partition by media_id, seq order by frame) as rn from f where tt>=t-0.1::double-1e-6::double and db>-20 and d1>-20 and d2>-20),
    y as (select media_id, seq, round((frame - case when coalesce(p1>-27,false) and coalesce(p2>-27,false) then 2 when coalesce(p1>-27,false) then 1 else 0 end)*0.02::double-0.02::double,2) as g from x where rn=1)
    select b2.media_id, b2.seq, coalesce(g, t) as suggested from b2 left join y using (media_id, seq)"""))
def win27b(spark, d):
    level = _level(spark, d)
    return fr.suggest_splice(_cut_points(level), level, ["seq"], "in").select("media_id", "seq", "suggested")


def _keeps(spark, d):
    """Kept stretches over the level frames: 40 frames kept, 10 removed."""
    grid = B.level(spark, d).groupBy("media_id", F.floor(F.col("frame") / 50).alias("g")).agg((F.min("frame") + 3).alias("f"))
    return grid.select("media_id", F.round(F.col("f") * 0.01, 2).alias("s"), F.round((F.col("f") + 40) * 0.01, 2).alias("e"))


_KEEPS = ", kp as (select media_id, round(f*0.01::double,2) as s, round((f+40)*0.01::double,2) as e from (select media_id, min(frame)+3 as f from level group by media_id, frame//50))"


@query("win30_join_silence", with_("level", _KEEPS + """, n as (select *, lead(s) over (partition by media_id order by s,e) as n0, lead(e) over (partition by media_id order by s,e) as n1 from kp),
    x as (select n.*, (select max(frame) from level l where l.media_id=n.media_id and db>=-12 and frame<=round_even(n.e/0.01::double,0)-1) as a, (select min(frame) from level l where l.media_id=n.media_id and db>=-12 and frame>=round_even(n.n0/0.01::double,0)) as b from n where n0 is not null),
    y as (select media_id, e, n0, round(least(e-s,(round_even(e/0.01::double,0)-1-coalesce(a,-1))*0.01::double)+least(n1-n0,coalesce((b-round_even(n0/0.01::double,0))*0.01::double,'inf'::double)),3) as silence from x)
    select * from y where silence>0.08::double"""))
def win30(spark, d):
    return fr.join_silence(_keeps(spark, d), B.level(spark, d), quiet=-12.0, over=0.08)


_VOICE = """, p95 as (select media_id, quantile_cont(db,0.95) as p from level group by 1),
    vl as (select media_id, quantile_cont(case when db>p-22 then db end,0.5) as speech, quantile_cont(case when not db>p-22 and db>-90 then db end,0.5) as pause from level join p95 using (media_id) group by 1)"""


@query("ag25_voice_music_gap", with_("level", _VOICE + " select media_id, round(speech-pause,6) as gap, case when speech-pause<8 then 'music_loud' when speech-pause>28 then 'music_lost' else 'ok' end as flag from vl"))
def ag25(spark, d):
    return fr.voice_music_gap(B.level(spark, d))


@query("flt16_join_loudness", with_("level", _VOICE + """, b as (select media_id, frame as seq, round(frame*0.01::double,2) as t from level),
    m as (select b.media_id, b.seq, avg(db) filter (l.frame>=floor(t/0.01::double-9+1e-6::double) and l.frame<floor(t/0.01::double-4+1e-6::double)) as bef, avg(db) filter (l.frame>=floor(t/0.01::double+4+1e-6::double) and l.frame<floor(t/0.01::double+9+1e-6::double)) as aft
      from b join level l on l.media_id=b.media_id and l.frame between b.seq-10 and b.seq+10 group by 1,2)
    select media_id, seq, round(bef,3) as before, round(aft,3) as after from m join vl using (media_id) where bef>speech-6 and aft>speech-6"""))
def flt16(spark, d):
    level = _level(spark, d)
    cuts = level.select("media_id", F.col("frame").alias("seq"), F.round(F.col("frame") * 0.01, 2).alias("t"))
    return fr.join_loudness(cuts, level, ["seq"]).select("media_id", "seq", "before", "after")


@query("flt15_sfx_over_voice", with_("level face", """select l.media_id, l.frame, -f.score*6 as db, l.db as voice_db from level l join face f on f.media_id=l.media_id and f.frame=l.frame
    where l.db>-26 and -f.score*6>-35"""))
def flt15(spark, d):
    sfx = B.face(spark, d).select("media_id", "frame", (-F.col("score") * 6).alias("db"))
    return fr.sfx_over_voice(sfx, B.level(spark, d))


@query("ag11_segment_p90", with_("level", """, sg as (select media_id, min(frame) as k, min(frame) as f0, min(frame)+45 as f1 from level group by media_id, frame//60),
    j as (select s.media_id, s.k, (l.frame-s.f0)//20 as piece, l.db from sg s join level l on l.media_id=s.media_id and l.frame>=s.f0 and l.frame<s.f1 and db>-55),
    lo as (select media_id, k, min(p) as lowest_piece from (select media_id, k, quantile_cont(db,0.9) as p, count(*) as n from j group by media_id, k, piece) where n>=8 group by 1,2),
    w as (select media_id, k, quantile_cont(db,0.9) as p90 from j group by 1,2)
    select s.media_id, s.k, round(p90,6) as p90, round(lowest_piece,6) as lowest_piece from sg s left join w using (media_id,k) left join lo using (media_id,k)"""))
def ag11(spark, d):
    lv = written(B.level(spark, d))
    grid = lv.groupBy("media_id", F.floor(F.col("frame") / 60).alias("g")).agg(F.min("frame").alias("k"))
    segs = grid.select("media_id", "k", F.col("k").alias("f0"), (F.col("k") + 45).alias("f1"))
    out = fr.segment_p90(segs, lv, ["k"], floor_db=-55.0)
    return out.select("media_id", "k", F.round("p90", 6).alias("p90"), F.round("lowest_piece", 6).alias("lowest_piece"))


@query("ag12_rank_tracks", with_("face", """, t as (select media_id, frame%3 as track, w-280 as db, score/100 as clipped, sharp/10000 as mean from face),
    s as (select media_id, track, count(*) as n, quantile_cont(db,0.75) as sp, quantile_cont(db,0.15) as no, avg(clipped) as cl, avg(case when db<-55 then 1.0::double else 0 end) as si, abs(avg(mean)) as dc from t group by 1,2),
    r as (select *, case when n<25 then -999 else round(sp-no-cl*900-greatest(0,-34-sp)*0.7::double-si*3-dc*40,3) end as score from s)
    select media_id, track, score, track=first_value(track) over (partition by media_id order by score desc, track) as best from r"""))
def ag12(spark, d):
    samples = B.face(spark, d).select(
        "media_id", (F.col("frame") % 3).alias("track"), (F.col("w") - 280).alias("db"), (F.col("score") / 100).alias("clipped"), (F.col("sharp") / 10000).alias("mean")
    )
    return fr.rank_tracks(samples)


@query("ag13_dominant_speaker", with_("speaker_window", """, n as (select media_id, cluster, count(*) as n from speaker_window group by 1,2),
    m as (select media_id, arg_max(cluster,(n,-cluster)) as main_cluster from n group by 1),
    u as (select s.*, main_cluster, list_transform(embedding, lambda x: x::double/sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double)))) as v from speaker_window s join m using (media_id)),
    d as (select media_id, i, avg(v[i]) as a from u, (select unnest(range(1,65)) as i) where cluster=main_cluster group by 1,2),
    c as (select media_id, list(a order by i) as c from d group by 1)
    select media_id, t_ms, main_cluster, round(list_sum(list_transform(range(1,65), lambda i: embedding[i]::double*c[i]))/sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double)))/sqrt(list_sum(list_transform(c, lambda y: y*y))),6) as sim from u join c using (media_id)"""))
def ag13(spark, d):
    out = fr.dominant_speaker(B.speaker_window(spark, d), 64)
    return out.select("media_id", "t_ms", "main_cluster", F.round("sim", 6).alias("sim"))


_FACE = """, f2 as (select *, case when frame%40<12 then 300.0::double else x end as fx, case when frame%40<12 then 200.0::double else w end as fw from face),
    s1 as (select *, (count(*) over b>=6 and max(fx) over b-min(fx) over b<1.5::double and max(fw) over b-min(fw) over b<1.5::double) or (count(*) over a>=6 and max(fx) over a-min(fx) over a<1.5::double and max(fw) over a-min(fw) over a<1.5::double) as st from f2
      window b as (partition by media_id order by t_ms range between 5000 preceding and current row), a as (partition by media_id order by t_ms range between current row and 5000 following)),
    s2 as (select *, bool_or(st) over (partition by media_id order by t_ms range between 1000 preceding and 1000 following) as static from s1)"""


def _faces(spark, d):
    hold = F.col("frame") % 40 < 12
    f = B.face(spark, d).withColumn("x", F.when(hold, 300.0).otherwise(F.col("x"))).withColumn("w", F.when(hold, 200.0).otherwise(F.col("w")))
    return f.withColumn("front", F.col("score") / 10)


@query("win37_static_faces", with_("face", _FACE + " select media_id, frame, static from s2"))
def win37(spark, d):
    return fr.static_faces(_faces(spark, d)).select("media_id", "frame", "static")


_PRE = _FACE + """, q as (select media_id, quantile_cont(case when not static then fw end,0.6) as w60, quantile_cont(sharp,0.95) as s95, max(fw) as wmax from s2 group by 1),
    pre as (select s2.*, fw/wmax+least(sharp,s95)*0.6::double/s95+score/10*0.5::double as pre from s2 join q using (media_id) where not static and fw>=w60 and score>0.3::double and score/10>0.02::double)"""


@query("top4_score_faces", with_("face", _PRE + " select media_id, frame, round(pre,6) as pre from pre"))
def top4(spark, d):
    scored = fr.score_faces(fr.static_faces(_faces(spark, d)), 0.3, 0.02)
    return scored.select("media_id", "frame", F.round("pre", 6).alias("pre"))


# The greedy choice as a recursion: the candidates in score order, each taken if nothing taken is near.
@query("top2_spaced_topk", _rec("face", """, f as (select media_id, t_ms, w*1000+x as sc, row_number() over (partition by media_id order by w*1000+x desc, t_ms) as rn from face),
    r as (select media_id, rn, [t_ms] as taken from f where rn=1
      union all select r.media_id, f.rn, case when len(taken)<5 and len(list_filter(taken, lambda p: abs(p-f.t_ms)<20000))=0 then list_append(taken, f.t_ms) else taken end from r join f on f.media_id=r.media_id and f.rn=r.rn+1 where len(taken)<5),
    z as (select media_id, arg_max(taken, rn) as taken from r group by 1)
    select media_id, unnest(taken) as t_ms, generate_subscripts(taken,1)-1 as pick from z"""))
def top2(spark, d):
    f = B.face(spark, d).select("media_id", "t_ms", (F.col("w") * 1000 + F.col("x")).alias("sc"))
    return fr.spaced_topk(f, "sc", "t_ms", 20000, 5).select("media_id", "t_ms", "pick")


@query("top3_spaced_events", _rec("interval", """, c as (select distinct media_id, s as t from "interval"),
    nx as (select a.media_id, a.t, min(b.t) as nxt from c a left join c b on b.media_id=a.media_id and b.t>=a.t+5000 group by 1,2),
    ch as (select media_id, min(t) as t, 0 as pick from c group by 1 union all select ch.media_id, nx.nxt, ch.pick+1 from ch join nx using (media_id, t) where nx.nxt is not null and ch.pick<6)
    select media_id, t, pick from ch where pick<6"""))
def top3(spark, d):
    ev = B.interval(spark, d).select("media_id", F.col("s").alias("t")).distinct()
    return fr.spaced_events(ev, "t", 5000.0, 6)


@query("top9_best", with_("probe", "select lufs, clip_id, duration from (select *, row_number() over (partition by lufs order by duration desc, clip_id) as rn from probe) where rn=1"))
def top9(spark, d):
    return fr.best(B.probe(spark, d).select("lufs", "clip_id", "duration"), ["lufs"], "duration", "clip_id")


@query("top10_widest_gap", with_("interval", """, n as (select media_id, s, lead(s) over (partition by media_id order by s) as e from "interval")
    select media_id, arg_max(s,(e-s,-s)) as s, arg_max(e,(e-s,-s)) as e from n where e is not null group by 1"""))
def top10(spark, d):
    return fr.widest_gap(B.interval(spark, d), "s")


@query("ag26_face_stats", with_("face", """select media_id, avg(case when score>=0.5::double then 1.0::double else 0 end) as present, quantile_cont(case when score>=0.5::double then w end,0.5) as median_w,
    quantile_cont(case when score>=0.5::double then x end,0.5) as median_x from face group by 1"""))
def ag26(spark, d):
    return fr.face_stats(B.face(spark, d), 0.5)


@query("ag27_caption_safe_y", with_("face", """select media_id, coalesce(cast(floor(least(1480,greatest(1180,quantile_cont(case when media_id%7<>0 then w*3 end,0.9)+136))) as bigint),1300) as caption_y from face group by 1"""))
def ag27(spark, d):
    faces = B.face(spark, d).withColumn("chin", F.when(F.col("media_id") % 7 != 0, F.col("w") * 3))
    return fr.caption_safe_y(faces)


@query("ag19_shot_crop", _rec("frame_diff face", _SHOTS + """, m as (select s.media_id, s.f0, s.f1, median(f.x) as fx from shot s left join face f on f.media_id=s.media_id and f.frame>=s.f0 and f.frame<s.f1 group by 1,2,3),
    cr as (select *, case when fx is not null then round(round(greatest(0,least(1,(fx-304)/1312.0::double))/0.005::double)*0.005::double,3) end as c from m)
    select media_id, f0, f1, coalesce(last_value(c ignore nulls) over (partition by media_id order by f0 rows between unbounded preceding and current row),0.5) as cropx from cr"""))
def ag19(spark, d):
    diff, face = B.diff_face(spark, d)
    return fr.shot_crop(face, fr.shots(diff, 50.0, 3), 1920.0, 608.0)


@query("win8_locf", with_("face", """select media_id, frame, last_value(case when score>=8 then x end ignore nulls) over (partition by media_id order by frame rows between unbounded preceding and current row) as x from face"""))
def win8(spark, d):
    f = B.face(spark, d).select("media_id", "frame", F.when(F.col("score") >= 8, F.col("x")).alias("x"))
    return fr.locf(f, "x", Layout(("media_id",), ("frame",)))


@query("win38_look_away", with_("face", """, r as (select media_id, quantile_cont(x,0.5) as mx, quantile_cont(w,0.5) as mw from face group by 1),
    a as (select f.media_id, f.frame from face f join r using (media_id) where abs(x-mx)>700 or abs(w-mw)>170),
    l as (select *, frame-lag(frame) over (partition by media_id order by frame) as gap from a), g as (select *, sum(case when gap is null or gap>2 then 1 else 0 end) over (partition by media_id order by frame) as run from l)
    select media_id, min(frame) as f0, max(frame)+1 as f1 from g group by media_id, run having max(frame)+1-min(frame)>=3"""))
def win38(spark, d):
    return fr.look_away(B.face(spark, d), "x", "w", 700.0, 170.0, 3)


def _levelled(spark, d):
    return _shots(spark, d).withColumn("level", (F.col("f0") * 7 + F.col("f1")) % 3)


_LEV = _SHOTS + ", lv as (select *, (f0*7+f1)%3 as level, row_number() over (partition by media_id order by f0)-1 as pos, (f1-f0)/30.0::double<0.5::double as short from shot)"


@query("win33_same_level_cuts", _rec("frame_diff", _LEV + " select media_id, f0, f1, level from (select *, lag(level) over (partition by media_id order by f0) as p from lv) where level=p"))
def win33(spark, d):
    return fr.same_level_cuts(_levelled(spark, d))


@query("win32_pingpong", _rec("frame_diff", _LEV + """, pr as (select *, short and lag(short) over (partition by media_id order by pos) as ok from lv),
    run as (select media_id, pos, f0, f1, pos as start, [level] as seen, 1 as n from pr where pos=0
      union all select r.media_id, p.pos, p.f0, p.f1, case when p.ok and len(list_distinct(list_append(r.seen,p.level)))<=2 then r.start else p.pos end,
        case when p.ok and len(list_distinct(list_append(r.seen,p.level)))<=2 then list_distinct(list_append(r.seen,p.level)) else [p.level] end,
        case when p.ok and len(list_distinct(list_append(r.seen,p.level)))<=2 then r.n+1 else 1 end from run r join pr p on p.media_id=r.media_id and p.pos=r.pos+1)
    select media_id, min(f0) as f0, max(f1) as f1, count(*) as shots from run group by media_id, start having count(*)>=4"""))
def win32(spark, d):
    return fr.pingpong(_levelled(spark, d), short_s=0.5)


_KFR = ", kf as (select media_id, min(frame)+2 as f0, min(frame)+27 as f1 from frame_diff group by media_id, frame//40)"


@query("win39_camera_ids", _rec("frame_diff", _KFR + """, mk as (select d.media_id, d.frame, k.f1 as ends, d.frame=k.f0 as head, d.diff>=48 as cut from frame_diff d join kf k on k.media_id=d.media_id and d.frame>=k.f0 and d.frame<k.f1 where d.diff>=48 or d.frame=k.f0),
    nx as (select a.media_id, a.frame, least((select min(frame) from mk b where b.media_id=a.media_id and b.cut and b.frame>=a.frame+6),(select min(frame) from mk b where b.media_id=a.media_id and b.head and b.frame>a.frame)) as nxt from mk a),
    ch as (select media_id, min(frame) as frame from mk group by 1 union all select ch.media_id, nx.nxt from ch join nx using (media_id, frame) where nx.nxt is not null),
    z as (select ch.media_id, ch.frame, ends, cut and ch.frame>min(ch.frame) over (partition by ch.media_id) as turn from ch join mk using (media_id, frame))
    select media_id, frame as f0, least(coalesce(lead(frame) over (partition by media_id order by frame), ends), ends) as f1, cast(sum(turn::int) over (partition by media_id order by frame) as bigint) as camera from z"""))
def win39(spark, d):
    diff = written(B.frame_diff(spark, d))
    grid = diff.groupBy("media_id", F.floor(F.col("frame") / 40).alias("g")).agg(F.min("frame").alias("f"))
    keep = grid.select("media_id", (F.col("f") + 2).alias("f0"), (F.col("f") + 27).alias("f1"))
    return fr.camera_ids(diff, keep, 48.0)


@query("win39_merge_equal", _rec("frame_diff", _LEV + """, p as (select *, level is distinct from lag(level) over (partition by media_id order by f0) as st from lv),
    g as (select *, sum(st::int) over (partition by media_id order by f0) as i from p) select media_id, min(f0) as f0, max(f1) as f1, any_value(level) as level from g group by media_id, i"""))
def win39b(spark, d):
    return fr.merge_equal(_levelled(spark, d), "level", Layout(("media_id",), ("f0",)))


@query("win21_fix_offsets", with_("face", """, p as (select media_id, frame as seq, x/1000 as "offset", 'b'||(frame%4) as src, frame*1.0::double as s, frame+1+(frame%3)*0.4::double as e, score/10 as score from face),
    v as (select a.*, list(struct_pack(o:=b."offset", src:=b.src) order by b.seq) as v from p a join p b on b.media_id=a.media_id and b.seq<>a.seq and abs(b.seq-a.seq)<=3 group by all),
    m as (select *, list_median(list_transform(v, lambda z: z.o)) as med, list_sort(list_transform(range(1,len(v)+1), lambda i: struct_pack(n:=-len(list_filter(v, lambda z: z.src=v[i].src)), i:=i, src:=v[i].src)))[1].src as common from v)
    select media_id, seq, case when x then med else "offset" end as "offset", case when x then common else src end as src, x as replaced from (select *, abs("offset"-med)>0.3::double and (e-s<1.5::double or score<0.6::double) as x from m)""".replace("list_median(", "list_aggregate(").replace("lambda z: z.o))", "lambda z: z.o), 'median')")))
def win21(spark, d):
    f = B.face(spark, d)
    pieces = f.select(
        "media_id", F.col("frame").alias("seq"), (F.col("x") / 1000).alias("offset"), F.concat(F.lit("b"), F.col("frame") % 4).alias("src"),
        (F.col("frame") * 1.0).alias("s"), (F.col("frame") + 1 + (F.col("frame") % 3) * 0.4).alias("e"), (F.col("score") / 10).alias("score"),
    )
    return fr.fix_offsets(pieces)


@query("win35_best_window", with_("level", """, v as (select media_id, frame, db+60 as v from level), pk as (select media_id, quantile_cont(v,0.95) as p, count(*) as n from v group by 1),
    w as (select media_id, frame, avg(v) over a as m, stddev_pop(v) over a as sd, avg(v) over b as x, avg(v) over c as y from v window a as (partition by media_id order by frame range between current row and 29 following),
      b as (partition by media_id order by frame range between current row and 14 following), c as (partition by media_id order by frame range between 15 following and 29 following)),
    s as (select w.media_id, frame, round((1-least(sd/(m+1e-9::double),1))*0.45::double+(1-least(abs((y-x)/(m+1e-9::double)-0.10::double)/0.35::double,1))*0.35::double+(1-least(greatest(m-p*0.85::double,0)/(p*0.3::double),1))*0.20::double,9) as score from w join pk using (media_id) where frame<n-30 and m>=p*0.35::double)
    select media_id, arg_max(frame,(score,-frame)) as start, round(max(score),6) as score from s group by 1"""))
def win35(spark, d):
    rms = B.level(spark, d).select("media_id", "frame", (F.col("db") + 60).alias("v"))
    return fr.best_window(rms, 30).withColumn("score", F.round("score", 6))


@query("win36_music_breaks", with_("level", """, co as (select media_id, frame//5 as frame, max(db) as db from level group by 1,2), md as (select media_id, quantile_cont(db,0.5) as med from co group by 1),
    g as (select co.media_id, frame, frame-row_number() over (partition by co.media_id order by frame) as run from co join md using (media_id) where db<med-10),
    r as (select media_id, min(frame) as f0, max(frame)+1 as f1 from g group by media_id, run having count(*)>=1),
    h as (select r.*, (select min(frame) from level l where l.media_id=r.media_id and l.db>=m.med-2 and l.frame>=r.f1*5-10) as hit from r join md m using (media_id))
    select media_id, f0, f1, hit, round(hit*0.05::double-1.0,6) as "offset" from h where round(hit*0.05::double-1.0,6)>=0"""))
def win36(spark, d):
    fine = B.level(spark, d)
    coarse = fine.groupBy("media_id", F.floor(F.col("frame") / 5).alias("frame")).agg(F.max("db").alias("db"))
    return fr.music_breaks(coarse, fine, target=1.0, least=1)


@query("ag20_series_target", with_("photo", """select series, least(129,greatest(117,quantile_cont(skin_angle,0.5))) as skin_angle, quantile_cont(skin_chroma,0.5) as skin_chroma from photo where faces>0 group by 1"""))
def ag20(spark, d):
    return fr.series_target(B.photo(spark, d))


@query("flt13_photo_flags", with_("photo", """, t as (select series, least(129,greatest(117,quantile_cont(skin_angle,0.5))) as a, quantile_cont(skin_chroma,0.5) as c from photo where faces>0 group by 1)
    select series, file, 'skin_angle' as flag from photo join t using (series) where abs(skin_angle-a)>6 union all select series, file, 'skin_chroma' from photo join t using (series) where abs(skin_chroma-c)>0.02::double"""))
def flt13(spark, d):
    photos = B.photo(spark, d)
    return fr.photo_flags(photos, fr.series_target(photos))


@query("win40_speech_blocks", _rec("interval", """, l as (select media_id, max(e)+60 as duration from "interval" group by 1),
    si as (select media_id, s, s+value_s as e from (select media_id, s, e-s+100 as value_s from "interval" where kind='error')),
    pz as (select media_id, round((s+e)/2,6) as c from "interval" where kind<>'error'),
    m as (select media_id, s, greatest(0,coalesce(max(e-1) over (partition by media_id order by s,e rows between unbounded preceding and 1 preceding),0)) as r from si),
    rg as (select media_id, r as s, s+1 as e from m union all select l.media_id, greatest(0,coalesce((select max(e-1) from si where si.media_id=l.media_id),0)), duration from l),
    ch as (select media_id, s, e, s as x from rg where e>s union all select ch.media_id, ch.s, ch.e, case when (select max(c) from pz where pz.media_id=ch.media_id and c<=ch.x+200000)>ch.x+160000 then
        (select max(c) from pz where pz.media_id=ch.media_id and c<=ch.x+200000) else ch.x+200000 end from ch where ch.e-ch.x>200000)
    select media_id, round(x,6) as s, coalesce(lead(x) over (partition by media_id, s, e order by x), e) as e from ch qualify coalesce(lead(x) over (partition by media_id, s, e order by x), e)-x>2"""))
def win40(spark, d):
    ev = B.interval(spark, d)
    lengths = ev.groupBy("media_id").agg((F.max("e") + 60).alias("duration"))
    silence = ev.filter("kind = 'error'").select("media_id", "s", (F.col("s") + (F.col("e") - F.col("s") + 100)).alias("e"))
    return fr.speech_blocks(silence, lengths, ev.filter("kind <> 'error'"), 200000.0)


