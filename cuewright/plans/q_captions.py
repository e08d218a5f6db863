"""Caption gates, delivery gates and clip checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.text import is_filler, is_long_vowel, jaccard, norm_keep, tokens
from cuewright.operators import clips as cl
from cuewright.operators import gates as g
from cuewright.operators import intervals as iv
from cuewright.operators import words as ws
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.registry import query
from cuewright.sources import sinks

_TOKENS = "list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'')"

QC_SQL = with_("caption", """, b as (select clip_id, seq, trim(text) as text, s, e, s>=0 and e>s as valid from caption),
  r as (select *, greatest(coalesce(max(case when valid then e end) over (partition by clip_id order by seq
        rows between unbounded preceding and 1 preceding),-1),-1) as reach,
      row_number() over (partition by clip_id order by seq)=1 as is_first,
      length(regexp_replace(text,'\\s+','','g')) as chars, e-s as dur from b),
  c as (select *, chars/greatest(dur,0.001::double) as cps, list_filter(string_split_regex(lower(text),'[^\\p{L}\\p{N}_\\p{M}]+'), lambda x: x<>'') as lw,
      string_split_regex(lower(text),'[\\s]+') as raw from r),
  f as (select *, is_first and dur>=0.28::double and chars<=16 as hook,
      len(list_filter(range(1,len(raw)), lambda i: regexp_extract(raw[i],'[\\p{L}\\p{N}_\\p{M}]+$')=regexp_extract(raw[i+1],'^[\\p{L}\\p{N}_\\p{M}]+') and regexp_extract(raw[i],'[\\p{L}\\p{N}_\\p{M}]+$')<>''))>0 as doubled from c),
  finding as (select clip_id, seq, s, e, text, round(dur,3) as duration, round(cps,2) as cps, x.severity as severity, x.code as code from (
    select *, unnest(list_filter([
      case when text='' then {'severity':'error','code':'empty_text'} end,
      case when not valid then {'severity':'error','code':'invalid_time'} end,
      case when valid and s<reach-0.03::double then {'severity':'error','code':'overlap'} end,
      case when valid and dur<0.18::double then {'severity':'warning','code':'too_short'} end,
      case when valid and dur>6 then {'severity':'warning','code':'too_long'} end,
      case when valid and cps>32 and hook then {'severity':'warning','code':'fast_opening_hook_review'} end,
      case when valid and cps>32 and not hook then {'severity':'error','code':'cps_excessive'} end,
      case when valid and cps<=32 and cps>24 then {'severity':'warning','code':'cps_high'} end,
      case when valid and length(text)>24 then {'severity':'warning','code':'block_long'} end,
      case when valid and doubled then {'severity':'warning','code':'repeated_word'} end], lambda x: x is not null)) as x from f)) """)


@query("flt1_caption_qc", QC_SQL + "select clip_id, seq, s, e, text, severity, code, duration, cps from finding")
def flt1(spark, d):
    return g.caption_qc(B.caption(spark, d))


@query("flt10_rollup_status", QC_SQL + """select clip_id, errors, warnings, case when errors>0 then 'FAIL' when warnings>0 then 'REVIEW_REQUIRED'
    else 'AUTOMATED_PASS' end as status from (select clip_id, count(code) filter (severity='error') as errors,
      count(code) filter (severity='warning') as warnings from (select distinct clip_id from caption) left join finding using (clip_id) group by 1)""")
def flt10(spark, d):
    caps = B.caption(spark, d)
    return g.rollup_status(g.caption_qc(caps), caps)


@query("snk3_findings_report", QC_SQL + """select clip_id, 0 as part, count(*) filter (severity='error') as errors, count(*) filter (severity='warning') as warnings,
    string_agg(seq||':'||code,',' order by seq, severity, code) as listed from finding group by 1""")
def snk3(spark, d):
    report = sinks.findings_report(g.caption_qc(B.caption(spark, d)))
    listed = F.array_join(F.transform("findings", lambda f: F.concat(f["seq"], F.lit(":"), f["code"])), ",")
    return report.select("clip_id", "part", "errors", "warnings", listed.alias("listed"))


@query("ag15_batch_summary", QC_SQL + """, st as (select clip_id, count(code) filter (severity='error') as errors from (select distinct clip_id from caption)
      left join finding using (clip_id) group by 1)
    select clip_id%4 as batch, count(*) as items, count(*) filter (clip_id%6<>0 and errors>0) as failures, count(*) filter (clip_id%6=0) as tool_errors
    from st group by 1""")
def ag15(spark, d):
    caps = B.caption(spark, d)
    items = caps.select("clip_id").distinct().withColumn("batch", F.col("clip_id") % 4)
    return g.batch_summary(items, g.caption_qc(caps), items.filter("clip_id % 6 <> 0"), "batch")


_LINED = r"regexp_replace(text, '\. ', '.' || chr(10), 'g')"
_STOP = "[" + ",".join(f"'{w}'" for w in g.FUNCTION_WORDS + ["the", "que"]) + "]"


@query("flt2_caption_rules", with_("caption", f"""
  , b as (select clip_id, seq, s, e, {_LINED} as t from caption),
  l as (select *, lag(e) over (partition by clip_id order by seq) as prev, string_split(t, chr(10)) as lines,
     length(regexp_replace(t,'\\s+','','g'))/greatest(e-s,0.001::double) as cps from b),
  f as (select *, list_transform(lines[1:len(lines)-1], lambda x: list_last(regexp_extract_all(translate(lower(x),'{K.ACCENTED}','{K.PLAIN}'),'[a-z0-9]+'))) as last_words from l)
  select clip_id, seq, x.severity as severity, x.code as code from (select clip_id, seq, unnest(list_filter([
    case when s<coalesce(prev,-1)-0.02::double then {{'severity':'error','code':'overlap'}} end,
    case when e>100-0.04::double then {{'severity':'error','code':'past_end'}} end,
    case when cps>24 then {{'severity':'warning','code':'cps_high'}} end,
    case when len(list_filter(lines, lambda x: length(x)>26))>0 then {{'severity':'warning','code':'line_long'}} end,
    case when len(list_filter(last_words, lambda x: list_contains({_STOP},x)))>0 then {{'severity':'error','code':'line_ends_in_function_word'}} end,
    case when regexp_matches(t,'(?i)onan') and not contains(t,'Onan') then {{'severity':'error','code':'brand_spelling'}} end], lambda x: x is not null)) as x from f)"""))
def flt2(spark, d):
    caps = B.caption(spark, d).withColumn("text", F.regexp_replace("text", r"\. ", ".\n"))
    stop = tuple(g.FUNCTION_WORDS + ["the", "que"])
    return g.caption_rules(caps, F.lit(100.0), {"onan": "Onan"}, stop)


_PLAN = "plan as (select clip_id, duration*0.99::double as total from probe where clip_id%3=0)"


@query("flt3_delivery_qc", with_("probe", f""", {_PLAN}
  select clip_id, x.severity as severity, x.code as code from (select p.clip_id, unnest(list_filter([
    case when width<>1080 or height<>1920 then {{'severity':'error','code':'wrong_dimensions'}} end,
    case when abs(fps-30)>0.05::double then {{'severity':'error','code':'wrong_fps'}} end,
    case when not (lufs between -19 and -13) then {{'severity':'warning','code':'loudness_outside_social_range'}} end,
    case when true_peak>-1 then {{'severity':'error','code':'true_peak_too_high'}} end,
    case when abs(duration-(total+0.8::double))>2 then {{'severity':'error','code':'duration_mismatch'}} end], lambda x: x is not null)) as x
    from probe p left join plan using (clip_id))"""))
def flt3(spark, d):
    probe = B.probe(spark, d)
    plan = probe.filter("clip_id % 3 = 0").select("clip_id", (F.col("duration") * 0.99).alias("total"))
    return g.delivery_qc(probe, plan)


@query("flt4_verify_cut", with_("probe", """select clip_id, x.name as name, x.passed as passed, x.value as value from (select clip_id, unnest([
    {'name':'minimum_width','passed':width>=1080,'value':cast(width as double)}, {'name':'minimum_height','passed':height>=1920,'value':cast(height as double)},
    {'name':'frame_rate','passed':abs(fps-30)<=0.05::double,'value':fps}, {'name':'duration','passed':abs(duration-50)<=2,'value':duration}]) as x from probe)"""))
def flt4(spark, d):
    return g.verify_cut(B.probe(spark, d), F.lit(50.0), 30.0, 1080, 1920, duration_tol=2.0)


def _sql_list(values):
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


@query("flt5_clip_edges", with_("word keep", f"""
  , clip as (select media_id as clip_id, media_id, min(s) as a, max(e) as z, sum(e-s) as kept from keep group by 1,2),
  h as (select c.media_id, string_agg(w.word,' ' order by w.seq) as t from clip c join word w on w.media_id=c.media_id and w.s<c.a+6-0.05::double and w.e>c.a+0.05::double group by 1),
  t as (select c.media_id, string_agg(w.word,' ' order by w.seq) as t from clip c join word w on w.media_id=c.media_id and w.s<c.z-0.05::double and w.e>c.z-6+0.05::double group by 1),
  p as (select c.media_id, kept, regexp_extract_all(coalesce(h.t,''),'[\\p{{L}}\\p{{N}}\\p{{M}}_À-ÿ%]+[.,!?;:…]*') as hw, regexp_extract_all(coalesce(t.t,''),'[\\p{{L}}\\p{{N}}\\p{{M}}_À-ÿ%]+[.,!?;:…]*') as tw
     from clip c left join h using (media_id) left join t using (media_id)),
  q as (select *, trim(lower(hw[1]),'.,!?;:…') as f0, tw[len(tw)] as la, trim(lower(tw[len(tw)]),'.,!?;:…') as lb from p)
  select media_id as clip_id, media_id, unnest(list_filter([
    case when list_contains({_sql_list(cl.CONNECTIVES)},f0) then 'opens_with_connective' end,
    case when len(list_filter(hw[1:6], lambda x: list_contains({_sql_list(cl.DEICTICS)},trim(lower(x),'.,!?;:…'))))>0 then 'dangling_reference' end,
    case when lower(hw[1][1])=hw[1][1] and upper(hw[1][1])<>hw[1][1] then 'lower_case_opening' end,
    case when la like '%,' or (list_contains({_sql_list(cl.BAD_TAILS)},lb) and not (la like '%.' or la like '%!' or la like '%?')) then 'bad_tail' end,
    case when not (kept between 45 and 90) then 'duration_out_of_range' end], lambda x: x is not null)) as flag from q"""))
def flt5(spark, d):
    clip = B.keep(spark, d).groupBy("media_id").agg(
        F.min("s").alias("first_s"), F.max("e").alias("last_e"), F.sum(F.col("e") - F.col("s")).alias("kept")
    ).withColumn("clip_id", F.col("media_id"))
    return cl.clip_edges(clip, B.word(spark, d), lo=45.0)


@query("flt6_keyword_hits", f"""select conv_id, turn from conversations where regexp_matches(text,
    '(?i)' || '{K.BACKSTAGE_PATTERN.replace(chr(39), chr(39) * 2)}|ch la|onan th') """)
def flt6(spark, d):
    segments = table(spark, d, "conversations")
    return g.keyword_hits(segments, K.BACKSTAGE_PATTERN + "|ch la|onan th").select("conv_id", "turn")


@query("flt7_stretched_words", with_("word keep", """select w.media_id, w.seq, w.word from word w join keep k on w.media_id=k.media_id and w.s<k.e and w.e>k.s
    where w.e-w.s>0.3::double and length(trim(w.word,'.,!?;:'))<=8 group by 1,2,3
    having round(sum(least(w.e,k.e)-greatest(w.s,k.s)),6)>0.03::double"""))
def flt7(spark, d):
    odd = g.stretched(B.word(spark, d), over=0.3)
    return iv.kept(odd, B.keep(spark, d), ["seq"]).select("media_id", "seq", "word")


@query("flt8_hesitations", with_("word keep", f"""select w.media_id, w.seq, case when regexp_matches(k0,'{K.FILLER_PATTERN}') then 'hesitation' else 'review_vowel' end as kind
    from (select *, trim(lower(word),'.,!?…;:"''') as k0 from word) w join keep k on w.media_id=k.media_id and w.s<k.e and w.e>k.s
    where regexp_matches(k0,'{K.FILLER_PATTERN}') or (regexp_matches(k0,'{K.LONG_VOWEL_PATTERN}') and w.e-w.s>0.09::double) group by 1,2,3
    having round(sum(least(w.e,k.e)-greatest(w.s,k.s)),6)>0.03::double"""))
def flt8(spark, d):
    filler = is_filler("word")
    odd = B.word(spark, d).filter(filler | is_long_vowel("word", F.col("e") - F.col("s"), 0.09))
    kind = F.when(filler, "hesitation").otherwise("review_vowel")
    return iv.kept(odd, B.keep(spark, d), ["seq"]).select("media_id", "seq", kind.alias("kind"))


@query("flt11_split_by_duration", with_("probe", "select clip_id, duration>60 as set_aside from (select clip_id, case when clip_id%9=0 then 0.0::double else duration end as duration from probe)"))
def flt11(spark, d):
    probe = B.probe(spark, d).withColumn("duration", F.when(F.col("clip_id") % 9 == 0, "n/a").otherwise(F.col("duration").cast("string")))
    short, long = g.split_by_duration(probe, 60.0)
    return short.select("clip_id", F.lit(False).alias("set_aside")).unionByName(long.select("clip_id", F.lit(True).alias("set_aside")))


@query("flt14_tail_check", with_("word keep", """, clip as (select media_id, s as k, e as out from keep),
    n as (select c.media_id, c.k, max(w.e) as last_e, bool_or(w.s<c.out and w.e>c.out) as across_out from clip c join word w on w.media_id=c.media_id and w.s<c.out and w.e>c.out-3 group by 1,2),
    j as (select c.*, least(coalesce(last_e,out),out) as fim, coalesce(across_out,false) as cut from clip c left join n using (media_id,k))
    select media_id, k as clip_id, round(fim,2) as s, out as e, round(out-fim,6) as slack from j where cut or round(out-fim,6)<0.5::double"""))
def flt14(spark, d):
    clip = B.keep(spark, d).select("media_id", F.col("s").alias("clip_id"), F.col("e").alias("out"))
    return cl.tail_check(clip, B.word(spark, d))


@query("jn12_clip_cues", with_("keep", f"""
  , cue as (select doc_id as media_id, n as seq, (n*5)::double as s, n*5+7.5::double as e, w[n*12+1:n*12+12] as w from (select doc_id, w, unnest(range((len(w)+11)//12)) as n from (select doc_id, {_TOKENS} as w from documents))),
  k as (select *, coalesce(sum(e-s) over (partition by media_id order by s rows between unbounded preceding and 1 preceding),0) as off from keep),
  p as (select c.media_id, c.seq, k.s as keep_s, k.off+(greatest(c.s,k.s)-k.s) as s, k.off+(least(c.e,k.e)-k.s) as e, w, (greatest(c.s,k.s)-c.s)/(c.e-c.s) as f0, (least(c.e,k.e)-c.s)/(c.e-c.s) as f1
     from cue c join k on k.media_id=c.media_id and c.s<k.e and c.e>k.s where least(c.e,k.e)-greatest(c.s,k.s)>0.02::double),
  q as (select *, cast(floor(len(w)*f0) as int) as i0, cast(round_even(len(w)*f1,0) as int) as i1 from p)
  select media_id, seq, keep_s, s, e, text from (select media_id, seq, keep_s, s, e, case when f1-f0>=0.85::double then array_to_string(w,' ')
    when i1>i0 then array_to_string(w[i0+1:greatest(i0+1,i1)],' ') else '' end as text from q) where text<>''"""))
def jn12(spark, d):
    n = F.col("seq")
    share = F.slice("w", (n * 12 + 1).cast("int"), 12)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), tokens("text").alias("w"))
    last = F.floor((F.size("w") - 1) / 12).cast("bigint")  # a cue of 12 words every 5 seconds, over the whole text
    cue = docs.filter(F.size("w") > 0).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "media_id", "seq", F.array_join(share, " ").alias("text"), (n * 5).cast("double").alias("s"), (n * 5 + 7.5).alias("e")
    )
    return cl.clip_cues(cue, B.keep(spark, d))


@query("jn21_override_captions", with_("caption", "select clip_id, seq, case when clip_id%3=0 then text||' (edited)' else text end as text from caption"))
def jn21(spark, d):
    caps = B.caption(spark, d).select("clip_id", "seq", "text")
    return g.override_captions(caps, caps.filter("clip_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" (edited)"))))


@query("jn26_missing_keywords", with_("caption", """, kw as (select distinct clip_id, unnest(['then','QUE','porto']) as keyword from caption)
    select clip_id, keyword from kw where not exists (select 1 from caption c where c.clip_id=kw.clip_id and contains(lower(c.text),lower(keyword)))"""))
def jn26(spark, d):
    caps = B.caption(spark, d)
    words = F.array(*[F.lit(k) for k in ("then", "QUE", "porto")])
    return g.missing_keywords(caps.select("clip_id").distinct().withColumn("keywords", words), caps)


@query("jn27_plan_vs_delivery", with_("probe", """, plan as (select clip_id, case when clip_id%4=0 then duration else duration*0.9::double end as total from probe)
    select clip_id, total+0.8::double as expected, p.duration, abs(p.duration-(total+0.8::double))<=2 as ok from plan
    left join (select clip_id, duration from probe where clip_id%5<>0) p using (clip_id)"""))
def jn27(spark, d):
    probe = B.probe(spark, d)
    total = F.when(F.col("clip_id") % 4 == 0, F.col("duration")).otherwise(F.col("duration") * 0.9)
    return g.plan_vs_delivery(probe.select("clip_id", total.alias("total")), probe.filter("clip_id % 5 <> 0"))


@query("top6_review_sample", with_("caption", """, r as (select *, row_number() over (partition by clip_id order by seq)-1 as i, count(*) over (partition by clip_id) as n,
      length(text)/greatest(e-s,0.001::double) as cps from caption),
    p as (select clip_id, any_value(n) as n, arg_max(i, (length(text), -i)) as lo, arg_max(i, (cps, -i)) as fa from r group by 1),
    c as (select clip_id, n, unnest(list_sort(list_distinct([0,n-1,lo,fa] || list_transform(range(4), lambda j: cast(round_even(j*(n-1)/3.0::double,0) as bigint))))[1:4]) as i from p)
    select r.clip_id, r.seq from r where n<=4 union all select r.clip_id, r.seq from r join c on c.clip_id=r.clip_id and c.i=r.i where r.n>4"""))
def top6(spark, d):
    return g.review_sample(B.caption(spark, d), 4).select("clip_id", "seq")


@query("set6_jaccard", f"""with t as (select conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(replace(lower(text),'’',''''),'[^{K.KEPT_LETTERS} ]',' ','g'),'\\s+'), lambda x: x<>'')) as w from conversations),
    p as (select a.conv_id, a.turn, len(list_intersect(a.w,b.w)) as i, len(list_distinct(a.w||b.w)) as u from t a join t b on b.conv_id=a.conv_id and b.turn=a.turn+1)
    select conv_id, turn, case when u>0 then i/u::double else 0 end as overlap from p""")
def set6(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", norm_keep("text").alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", jaccard("w", "v").alias("overlap"))


@query("set7_missing", "select distinct o_custkey as client from orders where o_custkey not in (select o_custkey from orders where o_orderstatus='F')")
def set7(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("client"), "o_orderstatus")
    return g.missing(orders.select("client").distinct(), orders.filter("o_orderstatus = 'F'"), ["client"])


@query("set3_all_findings", with_("word", f"""select media_id, seq, s, e, 'stretched' as kind from word where e-s>0.3::double and length(trim(word,'.,!?;:'))<=8
    union all select media_id, seq, s, e, 'hesitation' from word where regexp_matches(trim(lower(word),'.,!?…;:"'''),'{K.FILLER_PATTERN}')"""))
def set3(spark, d):
    words = B.word(spark, d)
    odd = g.stretched(words, over=0.3).withColumn("kind", F.lit("stretched"))
    fill = words.filter(is_filler("word")).withColumn("kind", F.lit("hesitation"))
    return g.all_findings(odd, fill).select("media_id", "seq", "s", "e", "kind").orderBy("media_id", "s", "kind")


_KEYED = "regexp_replace(lower(word),'[^0-9a-zà-ÿ]','','g')"


@query("win7_repeated_words", with_("word", f""", k as (select media_id, seq, word, {_KEYED} as k from word),
    l as (select *, lag(k,1) over w as k1, lag(k,2) over w as k2, lag(k,3) over w as k3 from k window w as (partition by media_id order by seq))
    select media_id, seq, 'word' as repeat from l where k<>'' and k=k1 and k<>'é'
    union all select media_id, seq, 'pair' from l where k3||k2=k1||k"""))
def win7(spark, d):
    return ws.repeated_words(B.word(spark, d)).select("media_id", "seq", "repeat")


