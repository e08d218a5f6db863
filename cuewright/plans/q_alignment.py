"""Alignment, word timing and caption timing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.text import norm_keep, norm_key, norm_strip, tokens
from cuewright.operators import alignment as al
from cuewright.operators import segmentation as sg
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.q_segmentation import _rec
from cuewright.plans.registry import query


def heard_pairs(spark, d):
    """Caption text and what was heard: each conversation turn against itself with some words of
    the turn lost or misheard."""
    t = table(spark, d, "conversations").select("conv_id", "turn", norm_keep("text").alias("a"))
    heard = F.filter(
        F.transform("a", lambda w, i: F.when(i % 11 == 5, F.lit("")).when(i % 17 == 3, F.concat(w, F.lit("s"))).otherwise(w)), lambda w: w != ""
    )
    return t.withColumn("b", heard)


@query("jn14_token_diff")
def jn14(spark, d):
    diffs = al.token_diff(heard_pairs(spark, d))
    return diffs.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), F.size("ops").alias("ops"))


@query("jn15_caption_vs_audio")
def jn15(spark, d):
    return al.caption_vs_audio(al.token_diff(heard_pairs(spark, d)), ["conv_id", "turn"])


@query("ag14_divergence_summary")
def ag14(spark, d):
    diffs = al.token_diff(heard_pairs(spark, d))
    return al.divergence_summary(diffs, al.caption_vs_audio(diffs, ["conv_id", "turn"]), ["conv_id", "turn"])


@query("jn16_polish_edges")
def jn16(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tokens("text").alias("raw"))
    t = t.withColumn("a", F.transform("raw", norm_strip))
    cut = F.col("turn") % 3
    one = F.when(cut == 0, F.expr("slice(a, 2, size(a))")).when(cut == 1, F.concat(F.array(F.lit("well")), F.col("a"))).otherwise(F.col("a"))
    two = F.when(cut == 2, F.expr("slice(a, 1, size(a) - 1)")).otherwise(one)
    first = al.token_diff(t.withColumn("b", one), autojunk=False)
    second = al.token_diff(t.withColumn("b", two), autojunk=False)
    return al.polish_edges(first, second, ["conv_id", "turn"], ("the",))


@query("jn17_superseded_takes")
def jn17(spark, d):
    caps = B.caption(spark, d)
    again = caps.select("clip_id", (F.col("s") + 5).alias("s"), (F.col("e") + 5).alias("e"), F.expr("substring(text, 4)").alias("text")).filter("clip_id % 2 = 0")
    return al.superseded_takes(caps.select("clip_id", "s", "e", "text").unionByName(again).withColumnRenamed("clip_id", "media_id"))


def _aligned(spark, d):
    w = B.turn_word(spark, d).select(F.col("clip_id").alias("media_id"), F.col("seq").alias("pos"), norm_key("word").alias("k"), "s", "e")
    kept = w.filter("pos % 7 <> 3").select("media_id", "k", (F.col("s") + (F.col("pos") % 5) * 0.05).alias("s"), (F.col("e") + 0.1).alias("e"), F.col("pos").alias("old"))
    from cuewright.operators.slices import Layout, position

    return w, position(kept, Layout(("media_id",), ("old",)), "pos").drop("old")


# The pointer walk of the aligner as a recursion over the words of a turn.
_ALIGN = """, w as (select clip_id as media_id, seq as pos, regexp_replace(lower(word),'[^0-9a-zà-ÿ]','','g') as k, s, e from turn_word),
    al as (select media_id, row_number() over (partition by media_id order by pos)-1 as j, k, s+(pos%5)*0.05::double as s, e+0.1::double as e from w where pos%7<>3),
    lst as (select media_id, list(k order by j) as ks from al group by 1),
    r as (select media_id, -1::bigint as pos, 0::bigint as j, cast(null as bigint) as m from (select distinct media_id from w)
      union all select r.media_id, w.pos, coalesce(r.j+x.hit, r.j), case when x.hit is not null then r.j+x.hit-1 end from r join w on w.media_id=r.media_id and w.pos=r.pos+1 join lst on lst.media_id=r.media_id,
        lateral (select nullif(coalesce(list_position(lst.ks[r.j+1:r.j+4], w.k),0),0) as hit) x)"""


@query("jn13_align_words", _rec("turn_word", _ALIGN + """ select w.media_id, w.pos, al.j is not null as aligned, round(coalesce(al.s, w.s),6) as s from w join r on r.media_id=w.media_id and r.pos=w.pos
    left join al on al.media_id=r.media_id and al.j=r.m"""))
def jn13(spark, d):
    asr, ref = _aligned(spark, d)
    return al.align_words(asr, ref).select("media_id", "pos", "aligned", F.round("s", 6).alias("s"))


@query("ag16_alignment_drift", _rec("turn_word", _ALIGN + """, z as (select w.media_id, w.pos, al.j is not null as ok, round(abs(al.s-w.s),3) as d from w join r on r.media_id=w.media_id and r.pos=w.pos left join al on al.media_id=r.media_id and al.j=r.m),
    q as (select media_id, avg(ok::int) as share, list(d order by d) filter (ok) as ds from z group by 1)
    select media_id, share, ds[cast(floor(len(ds)*0.5) as bigint)+1] as median, ds[cast(floor(len(ds)*0.9::double) as bigint)+1] as p90 from q"""))
def ag16(spark, d):
    asr, ref = _aligned(spark, d)
    return al.alignment_drift(al.align_words(asr, ref))


@query("jn30_locate", with_("level", """, q as (select media_id as query_id, frame-20 as frame, db from level where frame between 20 and 59),
    x as (select q.query_id, c.media_id, c.frame-q.frame as lag, round(corr(q.db,c.db),9) as score, count(*) as n from q join level c on c.media_id in (q.query_id+1, q.query_id+2) group by 1,2,3 having count(*)=40)
    select query_id, media_id, arg_max(lag,(score,-lag)) as frame, round(max(score),6) as score from x group by 1,2"""))
def jn30(spark, d):
    lv = B.level(spark, d)
    q = lv.filter("frame between 20 and 59").select(F.col("media_id").alias("query_id"), (F.col("frame") - 20).alias("frame"), "db")
    # Each excerpt is looked for in the two recordings made after its own.
    later = F.array(F.col("query_id") + 1, F.col("query_id") + 2)
    pairs = q.select("query_id").distinct().select("query_id", F.explode(later).alias("media_id"))
    return al.locate(pairs, q, lv).withColumn("score", F.round("score", 6))


@query("jn32_other_voice", with_("level keep word", """, sim as (select media_id, frame, (db+60)/50 as sim from level), sp as (select media_id, s+1 as s, e-1 as e from keep),
    g as (select *, frame-row_number() over (partition by media_id order by frame) as run from sim where sim<0.5::double),
    lo as (select media_id, min(frame) as f0, round(min(frame)*0.1::double,3) as s, round((max(frame)+1)*0.1::double,3) as e, avg(sim) as sim from g group by media_id, run having count(*)>=2),
    k as (select lo.* from lo where round((select sum(least(lo.e,p.e)-greatest(lo.s,p.s)) from keep p where p.media_id=lo.media_id and p.s<lo.e and p.e>lo.s),6)>0.03::double),
    c as (select k.*, coalesce((select sum(least(k.e,p.e)-greatest(k.s,p.s)) from sp p where p.media_id=k.media_id and p.s<k.e and p.e>k.s),0) as cov from k)
    select media_id, s, e, round(sim,6) as sim, coalesce((select string_agg(w.word,' ' order by w.seq) from word w where w.media_id=c.media_id and w.s<c.e and w.e>c.s),'') as text from c where round(cov/greatest(e-s,1e-3::double),6)>=0.5::double"""))
def jn32(spark, d):
    sim = B.level(spark, d).select("media_id", "frame", ((F.col("db") + 60) / 50).alias("sim"))
    keep = B.keep(spark, d)
    speech = keep.select("media_id", (F.col("s") + 1).alias("s"), (F.col("e") - F.lit(1)).alias("e"))
    return al.other_voice(sim, speech, keep, B.word(spark, d), below=0.5)


@query("jn33_drop_overlapped", """with recursive twin as (
      select conv_id as clip_id, (turn*10)::double as s, turn*10+0.4::double as e, text, false as repaired from conversations
      union all select conv_id, turn*10+0.1::double, (turn*10+0.4::double)+0.2::double, text||' ok', true from conversations),
    r as (select *, row_number() over (partition by clip_id order by s,e,text)-1 as pos,
      list_distinct(list_filter(string_split_regex(lower(text),'\\s+'), lambda x: x<>'')) as w from twin),
    fold as (
      select clip_id, pos, 0::bigint as seq, s, e, text, repaired, w from r where pos=0
      union all
      select clip_id, pos, seq+(not joined)::bigint, case when joined then least(s,s2) else s2 end, case when joined then greatest(e,e2) else e2 end,
        case when joined and mine>=its then text else text2 end, case when joined and mine>=its then repaired else repaired2 end,
        case when joined and mine>=its then w else w2 end
      from (select *, least(mine,its)<0.6::double and (repaired or repaired2) and len(list_intersect(w,w2))/greatest(len(list_distinct(w||w2)),1)>=0.5::double as joined
        from (select f.clip_id, r.pos, f.seq, f.s, f.e, f.text, f.repaired, f.w, r.s as s2, r.e as e2, r.text as text2, r.repaired as repaired2, r.w as w2,
          (f.e-f.s)/greatest(0.45::double, length(f.text)/20.0::double) as mine, (r.e-r.s)/greatest(0.45::double, length(r.text)/20.0::double) as its
          from fold f join r on r.clip_id=f.clip_id and r.pos=f.pos+1)))
    select clip_id, seq, arg_max(s,pos) as s, arg_max(e,pos) as e, arg_max(text,pos) as text from fold group by clip_id, seq""")
def jn33(spark, d):
    caps = B.caption(spark, d).select("clip_id", "s", (F.col("s") + 0.4).alias("e"), "text", F.lit(False).alias("repaired"))
    twin = caps.select("clip_id", (F.col("s") + 0.1).alias("s"), (F.col("e") + 0.2).alias("e"), F.concat("text", F.lit(" ok")).alias("text"), F.lit(True).alias("repaired"))
    return al.drop_overlapped(caps.unionByName(twin))


_TRIM = "trim(lower(word),'.,;:!?')"


@query("win9_drop_block_duplicates", with_("word", f""", k as (select *, {_TRIM} as k from word), l as (select *, lag(k,1) over w as p1, lag(k,2) over w as p2, lead(k) over w as n1, round(s/60)>=1 and abs(s-round(s/60)*60)<8 as edge from k window w as (partition by media_id order by seq)),
    m as (select *, edge and coalesce(k=p1,false) as same from l), p as (select *, edge and not same and coalesce(k=p2 and n1=p1,false) as pair from m),
    q as (select *, coalesce(lag(pair) over (partition by media_id order by seq),false) as pp from p) select media_id, seq from q where not same and not pair and not pp"""))
def win9(spark, d):
    return al.drop_block_duplicates(B.word(spark, d), 60.0, near=8.0).select("media_id", "seq")


@query("win10_repair_zero_time", with_("turn_word", """, z as (select clip_id as media_id, seq, word, case when seq%5<3 then round((seq//5)*2.0::double,3) else s end as s, e from turn_word),
    o as (select *, case when lag(s) over (partition by media_id order by seq) is null or s>lag(s) over (partition by media_id order by seq)+1e-6::double then 1 else 0 end as st from z),
    i as (select *, sum(st) over (partition by media_id order by seq) as i from o), g as (select media_id, i, min(s) as s0, max_by(e,seq) as e0, count(*) as n from i group by 1,2),
    h as (select *, lead(s0) over (partition by media_id order by i) as nx from g), r as (select i.*, s0, n, row_number() over (partition by i.media_id, i.i order by seq)-1 as k, greatest(coalesce(nx,e0), s0+0.12::double*n) as fim from i join h on h.media_id=i.media_id and h.i=i.i)
    select media_id, seq, case when n>1 then round(s0+(fim-s0)/n*k,3) else s end as s, case when n>1 then round(s0+(fim-s0)/n*(k+1),3) else e end as e, n>1 as repaired from r"""))
def win10(spark, d):
    w = B.turn_word(spark, d).withColumnRenamed("clip_id", "media_id")
    same = F.round(F.floor(F.col("seq") / 5) * 2.0, 3)
    z = w.withColumn("s", F.when(F.col("seq") % 5 < 3, same).otherwise(F.col("s")))
    return al.repair_zero_time(z).select("media_id", "seq", "s", "e", "repaired")


@query("win11_patch_words", with_("word", """, p as (select doc_id as media_id, 3.0::double as a, 5.5::double as b, [lang, 'spoken', source] as w from documents),
    x as (select media_id, a, b, unnest(w) as word, generate_subscripts(w,1) as i, list_sum(list_transform(w, lambda z: length(z))) as tot, w from p),
    y as (select media_id, word, round(a+(b-a)*coalesce(list_sum(list_transform(w[1:i-1], lambda z: length(z))),0)/tot,3) as s, round(a+(b-a)*list_sum(list_transform(w[1:i], lambda z: length(z)))/tot,3) as e from x where word<>'')
    select media_id, word, s, e from word w where not exists (select 1 from p where p.media_id=w.media_id and w.s>=a-1e-6::double and w.s<b) union all select * from y"""))
def win11(spark, d):
    docs = table(spark, d, "documents")
    patches = docs.select(F.col("doc_id").alias("media_id"), F.lit(3.0).alias("a"), F.lit(5.5).alias("b"), F.concat_ws(" ", "lang", F.lit("spoken"), "source").alias("text"))
    return al.patch_words(B.word(spark, d), patches)


@query("win12_interpolate_words", with_("turn_word", """, x as (select clip_id, seq//4 as cap, seq, word, case when seq%3<>1 then null else s end as s, case when seq%3<>1 then null else e end as e, (seq//4)*1.6::double as cs, (seq//4)*1.6::double+1.5::double as ce from turn_word),
    g as (select *, count(s) over (partition by clip_id, cap order by seq) as g from x),
    b as (select *, coalesce(last_value(e ignore nulls) over (partition by clip_id, cap order by seq rows between unbounded preceding and 1 preceding),cs) as lo, coalesce(first_value(s ignore nulls) over (partition by clip_id, cap order by seq rows between 1 following and unbounded following),ce) as hi from g),
    t as (select *, count(*) filter (s is null) over r as n, sum(length(word)+1) filter (s is null) over r as tot, sum(length(word)+1) filter (s is null) over (partition by clip_id, cap, g order by seq) as c from b window r as (partition by clip_id, cap, g))
    select clip_id, seq, case when s is not null then s else round(lo+(greatest(hi,lo+0.12::double*n)-lo)*(c-length(word)-1)/tot,3) end as s, case when s is not null then e else round(lo+(greatest(hi,lo+0.12::double*n)-lo)*c/tot,3) end as e,
      case when s is not null then 'asr' else 'interp' end as src from t"""))
def win12(spark, d):
    w = B.turn_word(spark, d)
    cap = F.floor(F.col("seq") / 4)
    sure = F.col("seq") % 3 == 1
    x = w.select(
        "clip_id", cap.alias("cap"), "seq", "word", F.when(sure, F.col("s")).alias("s"), F.when(sure, F.col("e")).alias("e"),
        (cap * 1.6).alias("cs"), (cap * 1.6 + 1.5).alias("ce"),
    )
    return al.interpolate_words(x).select("clip_id", "seq", "s", "e", "src")


@query("win13_fill_starts", with_("caption", """, x as (select clip_id, seq, case when seq%4=1 then s end as start, row_number() over (partition by clip_id order by seq)-1 as i from caption),
    y as (select *, last_value(case when start is not null then struct_pack(s:=start,i:=i) end ignore nulls) over (partition by clip_id order by seq rows between unbounded preceding and current row) as p,
      first_value(start ignore nulls) over (partition by clip_id order by seq rows between current row and unbounded following) as q from x)
    select clip_id, seq, round(coalesce(start, coalesce(q,500)-(coalesce(q,500)-coalesce(p.s,0))/pow(2.0::double, i-coalesce(p.i,-1))),6) as start from y"""))
def win13(spark, d):
    x = B.caption(spark, d).select("clip_id", "seq", F.when(F.col("seq") % 4 == 1, F.col("s")).alias("start"))
    return al.fill_starts(x, F.lit(500.0)).select("clip_id", "seq", F.round("start", 6).alias("start"))


@query("seg16_time_captions")
def seg16(spark, d):
    caps = B.caption(spark, d).withColumn("onset", F.when(F.col("seq") % 4 != 2, F.col("s") + 0.2))
    return al.time_captions(caps, "onset", "e", F.lit(500.0), {"The": 12.5})


_CORE = "rtrim(word,'.,;:…')"
_LOW = "regexp_replace(lower(word),'[^\\p{L}\\p{N}_%]','','g')"


@query("win34_display_case", with_("turn_word", f""", r as (select *, {_CORE} as core, {_LOW} as low, coalesce(lag(regexp_matches(word,'[.!?;:…]$')) over (partition by clip_id order by seq), true) as pe from turn_word),
    m as (select *, core<>'' and upper(core[1])=core[1] and lower(core[1])<>core[1] and not pe and not (upper(core)=core and lower(core)<>core) as mid, lower(core[1])=core[1] and upper(core[1])<>core[1] as lowstart from r),
    n as (select *, mid and low not in ('the','a') as solid from m), o as (select *, coalesce(lag(solid) over w,false) or coalesce(lead(solid) over w,false) as pair from n window w as (partition by clip_id order by seq)),
    c as (select clip_id, low, count(*) filter (mid) as caps, bool_or(lowstart) as lo from o group by 1,2),
    z as (select o.*, regexp_replace(translate(lower(core),'{K.ACCENTED}','{K.PLAIN}'),'[^a-z0-9%]','','g')='er' as listed, caps, lo from o join c using (clip_id, low)),
    y as (select *, case when solid and (listed or pair or (caps>=2 and not lo)) then core when mid and not listed then lower(core[1])||core[2:] else core end as sh from z)
    select clip_id, seq, case when sh='' then word else sh end as shown from y"""))
def win34(spark, d):
    return al.display_case(B.turn_word(spark, d), ["er"], ["the", "a"]).select("clip_id", "seq", "shown")


@query("seg11_choose_highlights")
def seg11(spark, d):
    scored = sg.highlight_score(sg.base_blocks(B.turn_word(spark, d)))
    return sg.choose_highlights(scored)


@query("seg5_caption_rhythm")
def seg5(spark, d):
    caps = sg.short_blocks(B.turn_word(spark, d)).withColumn("total", F.lit(10_000.0))
    return sg.caption_rhythm(caps)
