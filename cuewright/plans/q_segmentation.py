"""Caption and text segmentation over conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import segmentation as sg
from cuewright.operators.intervals import clip_to_next
from cuewright.operators.slices import Layout
from cuewright.plans import bindings as B
from cuewright.plans.bindings import with_
from cuewright.plans.registry import query

CAPS = Layout(("clip_id",), ("s", "e", "seq"), 3600.0)


def _rec(names: str, text: str) -> str:
    return with_(names, text).replace("with", "with recursive", 1)


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


# From the links nxt(clip_id, pos, nxt): the chain, and rows of r(clip_id, pos, ...) with their block.
CHAIN = """, ch as (select clip_id, min(pos) as pos from nxt group by 1
      union all select ch.clip_id, nxt.nxt from ch join nxt on nxt.clip_id=ch.clip_id and nxt.pos=ch.pos),
    st as (select distinct clip_id, pos, true as is_start from ch),
    bl as (select r.*, count(is_start) over (partition by r.clip_id order by r.pos)-1 as block from r left join st on st.clip_id=r.clip_id and st.pos=r.pos)"""

CLIPPED = """, r as (select clip_id, row_number() over (partition by clip_id order by s,e,seq)-1 as pos, s,
      least(e, lead(s) over (partition by clip_id order by s,e,seq)) as e, text from caption)"""


@query("seg1_transcript_blocks", _rec("caption", CLIPPED + """, nxt as (select i.clip_id, i.pos, coalesce(min(j.pos),1000000) as nxt from r i
      left join r j on j.clip_id=i.clip_id and j.pos>i.pos and j.e>i.s+15 group by 1,2)""" + CHAIN + """
    select clip_id as media_id, block, min(s) as s, max(e) as e, string_agg(text,' ' order by pos) as text from bl group by 1,2"""))
def seg1(spark, d):
    cues = clip_to_next(B.caption(spark, d), CAPS).withColumnRenamed("clip_id", "media_id").drop("seq")
    return sg.transcript_blocks(cues, 15.0)


_PAUSES = """, pauses as (select clip_id, s+9.5::double as s, s+9.5::double+case when seq%3=0 then 70.0::double else 5.0::double end as e from caption where seq%2=1)"""


@query("seg2_reading_blocks", _rec("caption", CLIPPED + _PAUSES + """, gaps as (select * from pauses where e-s>=60),
    nxt as (select i.clip_id, i.pos, least(
        coalesce((select min(j.pos)+1 from r j where j.clip_id=i.clip_id and j.pos>=i.pos and regexp_matches(j.text,'[.!?…]$') and j.e-i.s>=20),1000000),
        coalesce((select min(j.pos) from r j where j.clip_id=i.clip_id and j.pos>i.pos and exists (select 1 from gaps g join r k on k.clip_id=g.clip_id and k.pos=j.pos-1
          where g.clip_id=j.clip_id and g.s>=k.s and g.s<j.s)),1000000)) as nxt from r i)""" + CHAIN + """
    select clip_id as media_id, min(s) as s, max_by(e,pos) as e, string_agg(text,' ' order by pos) as text, 'speech' as kind from bl group by clip_id, block
    union all select clip_id, s, e, '', 'pause' from gaps"""))
def seg2(spark, d):
    caps = B.caption(spark, d)
    segs = clip_to_next(caps, CAPS).withColumnRenamed("clip_id", "media_id").drop("seq")
    length = F.when(F.col("seq") % 3 == 0, 70.0).otherwise(5.0)
    pauses = caps.filter("seq % 2 = 1").select(
        F.col("clip_id").alias("media_id"), (F.col("s") + 9.5).alias("s"), (F.col("s") + 9.5 + length).alias("e")
    )
    return sg.reading_blocks(segs, pauses, 60.0, 20.0)


@query("seg3_split_cues", _rec("turn_word", """, r as (select clip_id, seq as pos, word, len from turn_word),
    nxt as (select i.clip_id, i.seq as pos, coalesce(min(j.seq),1000000) as nxt from turn_word i left join turn_word j on j.clip_id=i.clip_id
       and j.seq>i.seq and j.seq<=i.seq+19 and j.cum-i.cum+i.len+j.seq-i.seq>18 group by 1,2)""" + CHAIN + """,
    p as (select clip_id, block as part, string_agg(word,' ' order by pos) as text from bl group by 1,2),
    q as (select p.*, length(p.text) as n, c.s, c.e, length(c.text) as whole, c.text as full_text from p join (select clip_id||'-'||seq as clip_id, s, e, text from caption) c using (clip_id)),
    t as (select *, sum(n) over (partition by clip_id) as total, coalesce(sum(n) over (partition by clip_id order by part rows between unbounded preceding and 1 preceding),0) as before,
       count(*) over (partition by clip_id) as parts from q)
    select clip_id, part, round(s+(e-s)*(before/total::double),3) as s, round(case when part=parts-1 then e else s+(e-s)*((before+n)/total::double) end,3) as e, text from t
    """).replace("with recursive", "with recursive caption as (select conv_id as clip_id, turn as seq, cast(turn*10 as double) as s, turn*10+length(text)/cast(20+10*(turn%4) as double) as e, text from conversations),", 1))
def seg3(spark, d):
    cues = B.caption(spark, d).withColumn("clip_id", F.concat_ws("-", "clip_id", "seq"))
    out = sg.split_cues(cues, 18, key=("clip_id",))
    return out.withColumn("s", F.round("s", 3)).withColumn("e", F.round("e", 3))


def atoms(spark, d):
    """Short atoms: one word each, so that merging has work to do."""
    return B.turn_word(spark, d).select("clip_id", "s", "e", F.col("word").alias("text"))


@query("seg4_merge_captions")
def seg4(spark, d):
    return sg.merge_captions(atoms(spark, d))


_SEG6_FUNC = _list(sorted(sg.CAPTION_FUNCTION_WORDS) + ["the", "und", "la"])


@query("seg6_greedy_captions", _rec("turn_word", f""", w as (select *, lead(len) over o as nlen, lead(s) over o-e as gap, regexp_matches(word,'[.?!]$') as sent,
      coalesce(lead(regexp_matches(word,'[.?!]$')) over o, false) as nsent, word like '%,' as comma, list_contains({_SEG6_FUNC}, lower(word)) as func
      from turn_word window o as (partition by clip_id order by seq)),
    run as (select *, seq-max(case when func then -1 else seq end) over (partition by clip_id order by seq) as tail from w),
    node as (select f.clip_id, f.seq as f, c.c, f.n from (select clip_id, seq, n from w union all select distinct clip_id, n, n from w) f
       join (select unnest(range(30)) as c) c on true
       left join run p on p.clip_id=f.clip_id and p.seq=f.seq-1 where c.c=0 or c.c<=least(coalesce(p.tail,0),f.seq)),
    stop as (select d.clip_id, d.f, d.c, d.n, min(j.seq) as j from node d join w j on j.clip_id=d.clip_id and j.seq>=d.f and j.seq<=d.f+26 and
       (j.sent or (j.comma and j.cum+j.seq-(select i.cum-i.len+i.seq from w i where i.clip_id=d.clip_id and i.seq=d.f-d.c)>=8) or j.seq=d.n-1 or j.gap>0.45::double or
        (j.cum+j.seq-(select i.cum-i.len+i.seq from w i where i.clip_id=d.clip_id and i.seq=d.f-d.c)+1+j.nlen>22 and not
         (j.nsent and j.cum+j.seq-(select i.cum-i.len+i.seq from w i where i.clip_id=d.clip_id and i.seq=d.f-d.c)+1+j.nlen<=25))) group by 1,2,3,4),
    nx as (select s.clip_id, s.f*32+31-s.c as pos, (s.j+1)*32+31-case when j.sent or (j.comma and j.cum+j.seq-(i.cum-i.len+i.seq)>=8) then 0
        else least(r.tail, s.j-(s.f-s.c)) end as nxt from stop s join w j on j.clip_id=s.clip_id and j.seq=s.j join run r on r.clip_id=s.clip_id and r.seq=s.j
        join w i on i.clip_id=s.clip_id and i.seq=s.f-s.c
      union all select clip_id, f*32+31-c, case when c>1 then f*32+32-c else 100000000 end from node where f=n and c>0),
    ch as (select clip_id, 31::bigint as pos from (select distinct clip_id from w) union all select ch.clip_id, nx.nxt from ch join nx on nx.clip_id=ch.clip_id and nx.pos=ch.pos),
    st as (select distinct clip_id, pos//32-(31-pos%32) as seq from ch where pos<100000000),
    bl as (select w.*, count(st.seq) over (partition by w.clip_id order by w.seq)-1 as block from w left join st on st.clip_id=w.clip_id and st.seq=w.seq)
    select clip_id, block as seq, min(s) as s, max_by(e,seq) as e, string_agg(word,' ' order by seq) as text from bl group by clip_id, block"""))
def seg6(spark, d):
    func = frozenset([*sg.CAPTION_FUNCTION_WORDS, "the", "und", "la"])
    return sg.greedy_captions(B.turn_word(spark, d), functions=func)


@query("seg7_short_blocks", _rec("turn_word", """, halves as (select clip_id, seq, s, e, case when seq%9=4 then '-'||word else word end as word from turn_word),
    numbered as (select *, sum(case when seq>0 and word like '-%' then 0 else 1 end) over (partition by clip_id order by seq)::bigint-1 as pos from halves),
    unit as (select clip_id, pos, min_by(s,seq) as s, max_by(e,seq) as e, count(*) as size, max_by(word,seq) as last, string_agg(word,' ' order by seq) as word from numbered group by 1,2),
    r as (select *, length(word) as len, sum(length(word)) over o as cum, sum(size) over o as words, count(*) over (partition by clip_id) as n
      from unit window o as (partition by clip_id order by pos)),
    nxt as (select i.clip_id, i.pos, min(j.pos)+1 as nxt from r i join r j on j.clip_id=i.clip_id and j.pos>=i.pos and j.pos<=i.pos+4
      and (j.words-i.words+i.size>=4 or j.cum-i.cum+i.len+j.pos-i.pos>=22 or regexp_matches(j.last,'[.?!]$')
        or (regexp_matches(j.last,'[,;:]$') and j.words-i.words+i.size>=2) or j.pos=j.n-1) group by 1,2)
    """ + CHAIN + """, g as (select clip_id, block as seq, min(s) as s, max_by(e,pos) as e, string_agg(word,' ' order by pos) as text from bl group by 1,2),
    h as (select clip_id, seq, s, greatest(e, s+0.12::double) as e, trim(ltrim(regexp_replace(text,'\\s+-','-','g'),',.;:!? ')) as text from g)
    select clip_id, seq, s, least(e, lead(s) over (partition by clip_id order by seq)) as e, text from h where text<>''"""))
def seg7(spark, d):
    # Recognisers write a hyphenated word as halves, the second with the hyphen; some words are made such halves.
    half = F.when(F.col("seq") % 9 == 4, F.concat(F.lit("-"), "word")).otherwise(F.col("word"))
    return sg.short_blocks(B.turn_word(spark, d).withColumn("word", half))


_SEG8_FUNC = _list(sorted(sg.BLOCK_FUNCTION_WORDS) + ["the", "und", "la"])


@query("seg8_base_blocks", _rec("turn_word", f""", w as (select *, lead(len) over o as nlen, regexp_matches(word,'[.!?;:…]$') or seq=n-1 or lead(s) over o-e>0.28::double as hard,
      list_contains({_SEG8_FUNC}, regexp_replace(lower(word),'[^\\p{{L}}\\p{{N}}_%]','','g')) as func from turn_word window o as (partition by clip_id order by seq)),
    node as (select clip_id, seq as i, c, n, cum-len+seq as base from w, (select unnest([0,1]) as c) where c=0 or func),
    stop as (select d.clip_id, d.i, d.c, min(j.seq) as j from node d join w j on j.clip_id=d.clip_id and j.seq>=d.i+d.c and j.seq<=d.i+6 and
      (j.hard or j.word like '%,' or j.seq-d.i+1>=4 or j.cum+j.seq-d.base+1+j.nlen>22) group by 1,2,3),
    nx as (select s.clip_id, 2*s.i+s.c as pos, case when not j.hard and j.func and j.seq>s.i then 2*j.seq+1 else 2*(j.seq+1) end as nxt from stop s
      join w j on j.clip_id=s.clip_id and j.seq=s.j),
    ch as (select clip_id, 0::bigint as pos from (select distinct clip_id from w) union all select ch.clip_id, nx.nxt from ch join nx on nx.clip_id=ch.clip_id and nx.pos=ch.pos),
    st as (select distinct clip_id, pos//2 as seq from ch)
    select w.clip_id, w.seq, count(st.seq) over (partition by w.clip_id order by w.seq)-1 as block from w left join st on st.clip_id=w.clip_id and st.seq=w.seq"""))
def seg8(spark, d):
    func = frozenset([*sg.BLOCK_FUNCTION_WORDS, "the", "und", "la"])
    return sg.base_blocks(B.turn_word(spark, d), functions=func).select("clip_id", "seq", "block")


@query("seg10_highlight_score", with_("turn_word", f""", k as (select clip_id, seq, word, regexp_replace(translate(lower(word),'áàâãäéèêëíìîïóòôõöúùûüçñ','aaaaaeeeeiiiiooooouuuucn'),'[^a-z0-9%]','','g') as p,
      regexp_replace(lower(word),'[^\\p{{L}}\\p{{N}}_%]','','g') as low from turn_word)
    select clip_id, seq, round(case when p='' or list_contains({_list(sorted(sg.BLOCK_FUNCTION_WORDS))},low) or list_contains({_list(sg.WEAK_WORDS)},p) then 0 else
      (case when length(p)>=5 then 0.6::double else 0 end)+(case when regexp_matches(word,'[0-9]') then 3 else 0 end)+(case when p in ('then','que') then 2.2::double else 0 end)
      +(case when list_contains({_list(sg.EMOTION)},p) then 1.8::double else 0 end)+(case when list_contains({_list(sg.STRONG_VERBS)},p) then 1.6::double else 0 end)
      +(case when length(p)>=8 then 0.3::double else 0 end)+(case when regexp_matches(word,'[.!?;:…]$') then 0.4::double else 0 end) end,6) as score from k"""))
def seg10(spark, d):
    scored = sg.highlight_score(B.turn_word(spark, d), ("then", "que"))
    return scored.select("clip_id", "seq", F.round("score", 6).alias("score"))


@query("seg15_absorb_short", _rec("turn_word", """, r as (select clip_id, seq as pos, word, len, round(s,6) as s, round(e,6) as e from turn_word),
    x as (select i.clip_id, i.seq as pos, min(j.seq) as nxt from turn_word i join turn_word j on j.clip_id=i.clip_id and j.seq>i.seq and j.seq<=i.seq+23
      and not (round(j.e,6)-round(j.s,6)<=0.18::double and j.cum-i.cum+i.len+j.seq-i.seq<=22) group by 1,2),
    nxt as (select r.clip_id, r.pos, coalesce(x.nxt,1000000) as nxt from r left join x using (clip_id,pos))""" + CHAIN + """,
    g as (select clip_id, block as seq, min_by(s,pos) as s, min_by(e,pos) as e0, max(e) as e1, count(*) as parts, string_agg(word,' ' order by pos) as text from bl group by 1,2),
    h as (select *, case when e0-s<=0.18::double then s+0.19::double else e0 end as he from g)
    select clip_id, seq, s, case when parts=1 then he else greatest(he,e1) end as e, text, parts from h"""))
def seg15(spark, d):
    return sg.absorb_short(atoms(spark, d))


@query("seg17_limit_emphasis", with_("caption", """, f as (select clip_id, seq, length(text)%2=0 as any_emph from caption),
    m as (select *, count(*) over (partition by clip_id) as n, count(*) filter (any_emph) over (partition by clip_id) as m,
      count(*) filter (any_emph) over (partition by clip_id order by seq)-1 as r from f),
    l as (select *, greatest(1, cast(floor(n*0.3::double) as bigint)) as lim from m)
    select clip_id, seq, any_emph, any_emph and (m<=lim or len(list_filter(range(lim), lambda j: round_even(j*(m-1)/greatest(lim-1,1)::double,0)=r))>0) as keep_emph from l"""))
def seg17(spark, d):
    caps = B.caption(spark, d).select("clip_id", "seq", (F.length("text") % 2 == 0).alias("any_emph"))
    return sg.limit_emphasis(caps, 0.3)


