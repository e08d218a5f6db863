"""Catalogue, events, feedback, rubric and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import constants as K
from cuewright.functions.text import sentence_tags
from cuewright.operators import catalog as ca
from cuewright.operators import events as ev
from cuewright.plans import bindings as B
from cuewright.plans.bindings import table, with_
from cuewright.plans.q_functions import _FOLD, _PATH, _TAGS, _slug_sql, typed_paths
from cuewright.plans.q_sources import TURN_SQL, session_lines
from cuewright.plans.registry import query
from cuewright.sources import files, logs


@query("ag9_duplicate_files", with_("file", """select path, size, hash, count(*) over (partition by size, hash) as copies, min(path) over (partition by size, hash) as first_path
    from file qualify copies>1"""))
def ag9(spark, d):
    return ca.duplicate_files(B.file(spark, d))


@query("ag10_quick_hash", "select doc_id, substr(sha256(strlen(text)::varchar || text),1,20) as qhash from documents")
def ag10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    return docs.withColumn("n", F.octet_length("body")).select("doc_id", files.quick_hash("body", "n").alias("qhash"))


@query("src11_file_inventory", f"""select root, files, bytes from (select source as root, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents where doc_id%17<>0 group by 1)""")
def src11(spark, d):
    name = F.when(F.col("doc_id") % 34 == 0, ".DS_Store").when(F.col("doc_id") % 17 == 0, "._x").otherwise("a.txt")
    listed = table(spark, d, "documents").select("source", name.alias("name"), "n_chars")
    return files.visible(listed, "name").groupBy(F.col("source").alias("root")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


def assets(spark, d):
    """A catalogue: documents as files, with tags, notes and content hashes."""
    docs = typed_paths(spark, d).join(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select(
        F.concat(F.lit("a"), "doc_id").alias("id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), ca.guess_type("path").alias("type"),
        F.when(F.col("doc_id") % 3 == 0, "_global").otherwise(F.col("lang")).alias("client"),
        F.array_compact(F.array("lang", F.when(F.col("doc_id") % 5 == 0, "favorito"))).alias("tags"),
        F.when(F.col("doc_id") % 4 == 0, "first note").otherwise("").alias("note"), F.col("path"), F.col("source"), F.md5(F.col("text").cast("binary")).alias("qhash"), "doc_id",
    )


ASSET = f"""asset as (select 'a'||doc_id as id, regexp_extract(p,'([^/]*)$',1) as name, p as path, doc_id, md5(text) as qhash,
    case when doc_id%3=0 then '_global' else lang end as client, list_filter([lang, case when doc_id%5=0 then 'favorito' end], lambda x: x is not null) as tags,
    case when doc_id%4=0 then 'first note' else '' end as note, source from (select *, {_PATH} as p from documents)),
  typed as (select a.*, k.kind as type from asset a join ({{kinds}}) k using (doc_id))"""


def _asset_sql(text):
    from cuewright.plans.registry import QUERIES

    return "with " + ASSET.replace("{kinds}", QUERIES["fn23_guess_type"].sql) + text


_HAY = _slug_sql("id||' '||name||' '||type||' '||client||' '||array_to_string(tags,' ')||' '||note||' '||source", "-")


@query("jn18_search_assets", _asset_sql(f""", h as (select *, {_HAY} as hay, {_slug_sql('name','-')} as sname from typed where client in ('fr','_global')),
    s as (select id, list_sum(list_transform(['doc','fr','burn'], lambda t: case when contains(hay,t) then case when contains(sname,t) or list_contains(tags,t) then 3 else 1 end else 0 end)) as s0, tags from h)
    select id, cast(s0+case when list_contains(tags,'favorito') then 2 else 0 end as int) as score from s where s0>0 order by score desc, id limit 25"""))
def jn18(spark, d):
    return ca.search_assets(assets(spark, d), ["doc", "fr", "burn"], client="fr", n=25).select("id", "score")


@query("jn19_relink", _asset_sql(""", f as (select qhash, path||'.moved' as path from asset where doc_id%7=0 union all select qhash, path from asset where doc_id%7>2),
    g as (select * from asset a where not exists (select 1 from f where f.path=a.path)), m as (select qhash, min(path) as new_path from f group by 1)
    select id, new_path, case when new_path is null then 'missing' else 'relinked' end as state from g left join m using (qhash)"""))
def jn19(spark, d):
    a = assets(spark, d).select("id", "path", "qhash", "doc_id")
    moved = a.filter("doc_id % 7 = 0").select("qhash", F.concat("path", F.lit(".moved")).alias("path"))
    found = moved.unionByName(a.filter("doc_id % 7 > 2").select("qhash", "path"))
    return ca.relink(a, found).select("id", "new_path", "state")


@query("jn20_merge_assets", _asset_sql(f""", old as (select *, row_number() over (partition by qhash order by doc_id) as rn from typed where doc_id%2=0 qualify rn=1),
    inc as (select *, ['new', lang2] as tags2, case when doc_id%6=1 then 'second note' else '' end as note2 from (select t.*, d.lang as lang2 from typed t join documents d using (doc_id)) where doc_id%2=1 or doc_id%8=0),
    g as (select qhash, list_sort(list_distinct(flatten(list(tags2)))) as tags2, list_sort(list_distinct(list(nullif(note2,'')))) as notes, min(path) as first from inc group by 1),
    upd as (select old.id, list_sort(list_distinct(old.tags||coalesce(g.tags2,[]))) as tags, case when old.note='' then coalesce(array_to_string(list_filter(g.notes, lambda n: n is not null),' | '),'')
        when coalesce(len(list_filter(g.notes, lambda n: n is not null)),0)>0 then old.note||' | '||array_to_string(list_filter(g.notes, lambda n: n is not null),' | ') else old.note end as note from old left join g using (qhash)),
    new as (select g.*, regexp_extract(first,'([^/]*)$',1) as name from g where qhash not in (select qhash from old))
    select 'known' as origin, id, array_to_string(tags,',') as tags, note from upd
    union all select 'new', name, array_to_string(tags2,','), coalesce(array_to_string(list_filter(notes, lambda n: n is not null),' | '),'') from new"""))
def jn20(spark, d):
    a = assets(spark, d)
    even = a.filter("doc_id % 2 = 0")
    first = even.groupBy("qhash").agg(F.min("doc_id").alias("doc_id"))
    old = even.join(first, ["qhash", "doc_id"]).drop("doc_id")
    lang = table(spark, d, "documents").select("doc_id", "lang")
    inc = a.filter("doc_id % 2 = 1 or doc_id % 8 = 0").join(lang, "doc_id").select(
        "qhash", "path", F.array(F.lit("new"), "lang").alias("tags"), F.when(F.col("doc_id") % 6 == 1, "second note").otherwise("").alias("note")
    )
    catalog, _ = ca.merge_assets(old, inc)
    known = F.col("client").isNotNull()
    return catalog.select(
        F.when(known, "known").otherwise("new").alias("origin"), F.when(known, F.col("id")).otherwise(F.col("name")).alias("id"),
        F.array_join("tags", ",").alias("tags"), "note",
    )


@query("jn20_merged_ids", _asset_sql(""" select count(distinct qhash) as items, count(distinct qhash) as distinct_ids from asset"""))
def jn20b(spark, d):
    a = assets(spark, d)
    known = a.filter("doc_id % 2 = 0")
    first = known.groupBy("qhash").agg(F.min("doc_id").alias("doc_id"))
    catalog, _ = ca.merge_assets(known.join(first, ["qhash", "doc_id"]), a.select("qhash", "path", "tags", "note"))
    return catalog.agg(F.count("*").alias("items"), F.count_distinct("id").alias("distinct_ids"))


@query("jn28_pending", with_("file", """, m as (select path, hash, 'm1' as model from file where size%3=0)
    select path, hash from file f where not exists (select 1 from m where m.path=f.path and m.hash=f.hash and m.model='m1')"""))
def jn28(spark, d):
    f = B.file(spark, d).withColumn("model", F.lit("m1"))
    return ca.pending(f, f.filter("size % 3 = 0"), ["path", "hash", "model"]).select("path", "hash")


@query("set2_edit_tags", _asset_sql(" select id, array_to_string(list_sort(list_distinct(tags||['b','new','b'])),',') as added, 'b,new' as replaced from asset"))
def set2(spark, d):
    more = F.array(F.lit("b"), F.lit("new"), F.lit("b"), F.lit(""))
    return assets(spark, d).select(
        "id", F.array_join(ca.edit_tags("tags", more), ",").alias("added"), F.array_join(ca.edit_tags("tags", more, True), ",").alias("replaced")
    )


_FOLDER = "[" + ",".join(f"'{x}'" for x in (*K.LAYOUT_REQUIRED, *K.LAYOUT_SUBDIRS)) + "]"
_LAYOUT_ROWS = ",".join([f"('{p}','error','missing_directory')" for p in K.LAYOUT_REQUIRED] + [f"('{p}','warning','missing_subdirectory')" for p in K.LAYOUT_SUBDIRS])


@query("flt9_audit_layout", f"""with f as (select source as root, case when doc_id%19=0 then '' else {_FOLDER}[(doc_id%13)+1]||'/' end || regexp_extract({_PATH},'([^/]*)$',1) as path from documents),
    req(path, severity, code) as (values {_LAYOUT_ROWS}),
    dirs as (select distinct root, unnest([string_split(path,'/')[1], array_to_string(string_split(path,'/')[1:2],'/')]) as path, unnest([1,2]) as depth, len(string_split(path,'/'))-1 as have from f),
    c as (select *, case when regexp_matches(path,'{K.RAW_HINT}') then 'raw' when regexp_matches(path,'{K.STOCK_HINT}') then 'stock' when regexp_matches(path,'{K.VFX_HINT}') then 'vfx' else 'none' end as hint,
       lower(regexp_extract(path,'\\.([^./]+)$',1)) in ({",".join(f"'{x}'" for x in K.LAYOUT_VIDEO_EXT)}) as video from f)
    select r.root, req.path, req.severity, req.code from (select distinct root from f) r, req where not exists (select 1 from dirs where dirs.root=r.root and dirs.path=req.path and depth<=have)
    union all select root, path, 'warning', 'loose_root_item' from c where not list_contains({_FOLDER}, string_split(path,'/')[1])
    union all select root, path, 'warning', 'unstable_name' from c where regexp_matches(regexp_extract(path,'([^/]*)\\.[^.]*$',1),'{K.UNSTABLE_HINT}')
    union all select root, path, 'error', case hint when 'none' then 'unclassified' else hint end||'_video_forbidden_in_drive' from c where video and hint<>'vfx'""")
def flt9(spark, d):
    folders = F.array(*[F.lit(x) for x in (*K.LAYOUT_REQUIRED, *K.LAYOUT_SUBDIRS)])
    docs = typed_paths(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    inside = F.concat(F.get(folders, F.col("doc_id") % 13), F.lit("/"), name)
    listed = docs.select(F.col("source").alias("root"), F.when(F.col("doc_id") % 19 == 0, name).otherwise(inside).alias("path"))
    return ca.audit_layout(listed, staging=True)


@query("top7_fit_tags", f"""with t as (select doc_id, {_TAGS} as t from documents), c as (select doc_id, t, len(list_filter(range(1,len(t)+1), lambda i:
      list_sum(list_transform(t[1:i], lambda x: length(x)+case when contains(x,' ') then 2 else 0 end))+i-1<=500)) as k from t where len(t)<=400)
    select doc_id, k as kept, len(t)-k as cut from c union all
    select doc_id, len(list_filter(range(1,401), lambda i: list_sum(list_transform(t[1:i], lambda x: length(x)+case when contains(x,' ') then 2 else 0 end))+i-1<=500)) as k, len(t)-k from t where len(t)>400""")
def top7(spark, d):
    fit = ca.fit_tags(sentence_tags("text"), 500)
    return table(spark, d, "documents").select("doc_id", fit.alias("f")).select("doc_id", F.size("f.kept").alias("kept"), F.size("f.cut").alias("cut"))


@query("ag29_tag_report", f"""select doc_id, len(t) as n_tags, length(array_to_string(t,',')) as text_length, length(array_to_string(t,',')) + 2*len(list_filter(t, lambda x: contains(x,' '))) as cost,
    len(t)-len(list_distinct(list_transform(t, lambda x: lower(x)))) as repeats from (select doc_id, {_TAGS} as t from documents)""")
def ag29(spark, d):
    return ca.tag_report(table(spark, d, "documents").select("doc_id", sentence_tags("text").alias("tags")), "doc_id")


@query("win41_black_segments", with_("interval", """, b as (select media_id, s, least(e, lead(s) over (partition by media_id order by s,e)) as e from "interval"),
    l as (select media_id, max(e)+500 as duration from b group by 1), x as (select media_id, s, e from b union all select media_id, duration, duration from l),
    n as (select *, lag(s) over o as ps, lag(e) over o as pe from x window o as (partition by media_id order by s,e))
    select media_id, round(greatest(0, coalesce(pe,0)-case when pe is null then 0 else least(0.4::double,(pe-ps)/2) end),3) as s, round(least(duration, s+least(0.4::double,(e-s)/2)),3) as e
    from n join l using (media_id) where s-coalesce(pe,0)>0.15::double"""))
def win41(spark, d):
    from cuewright.operators.intervals import clip_to_next, timed

    black = clip_to_next(B.interval(spark, d), timed("media_id", "s", "e"))
    lengths = black.groupBy("media_id").agg((F.max("e") + 500).alias("duration"))
    return ca.black_segments(black, lengths)


@query("win31_max_gap", with_("interval", """, l as (select media_id as clip_id, max(e)+60 as duration from "interval" group by 1),
    m as (select media_id as clip_id, s as t from "interval" union all select clip_id, 0 from l union all select clip_id, duration from l),
    g as (select clip_id, t-lag(t) over (partition by clip_id order by t) as gap from m) select clip_id, max(gap) as max_gap from g group by 1"""))
def win31(spark, d):
    e = B.interval(spark, d).withColumnRenamed("media_id", "clip_id")
    lengths = e.groupBy("clip_id").agg((F.max("e") + 60).alias("duration"))
    return ev.max_gap(e.select("clip_id", F.col("s").alias("t")), lengths)


@query("ag28_edit_map", with_("interval", """, l as (select media_id, max(e)+60 as duration from "interval" group by 1)
    select media_id as clip_id, kind, count(*) as events, count(*)/any_value(duration) as per_second from "interval" join l using (media_id) group by 1,2"""))
def ag28(spark, d):
    e = B.interval(spark, d).withColumnRenamed("media_id", "clip_id")
    lengths = e.groupBy("clip_id").agg((F.max("e") + 60).alias("duration"))
    return ev.edit_map(e, lengths)


_LABELS = "lab as (select p_brand as panel, p_partkey as id, cast(p_size*20 as double) as y, cast(p_partkey%900 as double) as x0, p_partkey%900+length(p_name)*9.0::double as x1 from part)"


@query("jn25_label_overlaps", f"""with {_LABELS} select a.panel, a.id, b.id as id2 from lab a join lab b on a.panel=b.panel and a.id<b.id
    and abs(a.y-b.y)<44 and a.x0<b.x1-8 and b.x0<a.x1-8""")
def jn25(spark, d):
    x0 = (F.col("p_partkey") % 900).cast("double")
    labels = table(spark, d, "part").select(
        F.col("p_brand").alias("panel"), F.col("p_partkey").alias("id"), (F.col("p_size") * 20).cast("double").alias("y"), x0.alias("x0"),
        (x0 + F.length("p_name") * 9.0).alias("x1"),
    )
    return ev.label_overlaps(labels)


@query("jn24_unspoken_labels", with_("word keep", f""", lab as (select k.media_id, k.s as label_id, k.s+4 as t, b.text from keep k join
      (select item_id, text, count(*) over () as n from benchmark) b on b.item_id=(k.media_id*5+cast(k.s as bigint)//12)%b.n),
    st as (select distinct media_id, label_id, t, text, unnest(list_transform(regexp_extract_all({_FOLD.format('text')},'[a-zà-ÿ]{{4,}}'), lambda w: w[1:5])) as stem from lab),
    hit as (select distinct st.media_id, st.label_id from st join word w on w.media_id=st.media_id and w.s>st.t-8 and w.s<st.t+8 and contains({_FOLD.format('w.word')}, stem))
    select distinct media_id, label_id from st where not exists (select 1 from hit where hit.media_id=st.media_id and hit.label_id=st.label_id)"""))
def jn24(spark, d):
    texts = table(spark, d, "benchmark").select("item_id", "text")
    n = texts.agg(F.count("*").alias("n"))
    keep = B.keep(spark, d).join(F.broadcast(n))  # one row
    item = (F.col("media_id") * 5 + F.floor(F.col("s") / 12)) % F.col("n")
    labels = keep.withColumn("item_id", item).join(texts, "item_id").select(
        "media_id", F.col("s").alias("label_id"), (F.col("s") + 4).alias("t"), "text"
    )
    return ev.unspoken_labels(labels, B.word(spark, d)).select("media_id", "label_id")


@query("ag1_feedback_summary", with_("feedback", """, f as (select category, client::varchar as client, case when event_id%3=0 then '-' else 's'||(event_id%5) end as skill from feedback where date>=date '2024-01-03')
    select 'category' as dimension, category as value, count(*) as n from f group by 2 union all select 'client', client, count(*) from f group by 2 union all select 'skill', skill, count(*) from f group by 2"""))
def ag1(spark, d):
    f = B.feedback(spark, d).withColumn("skill", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("s"), F.col("event_id") % 5)))
    return ev.feedback_summary(f, F.lit("2024-01-03").cast("date"))


@query("top5_tail_feedback", with_("feedback", "select event_id, client, text from feedback where category='error' order by event_id desc limit 20"))
def top5(spark, d):
    return ev.tail_feedback(B.feedback(spark, d), 20, "error").select("event_id", "client", "text")


@query("top8_pick_quota", """with c as (select o_custkey%60 as episode, case when o_orderstatus='F' then 'host' when o_orderstatus='O' then 'guest' else 'other' end as speaker, o_orderkey as cand_id, o_totalprice as score from orders),
    n as (select episode, count(*) filter (speaker='host') as a, count(*) filter (speaker='guest') as b from c group by 1),
    q as (select episode, case when a>=4 and b>=2 then 4 when a>=3 and b>=3 then 3 when a>=2 and b>=4 then 2 end as qa, case when a>=4 and b>=2 then 2 when a>=3 and b>=3 then 3 when a>=2 and b>=4 then 4 end as qb from n),
    r as (select *, row_number() over (partition by episode, speaker order by score desc, cand_id) as rank from c)
    select episode, speaker, cand_id, rank from r join q using (episode) where qa is not null and rank<=case speaker when 'host' then qa when 'guest' then qb else 0 end""")
def top8(spark, d):
    status = F.col("o_orderstatus")
    cand = table(spark, d, "orders").select(
        (F.col("o_custkey") % 60).alias("episode"), F.when(status == "F", "host").when(status == "O", "guest").otherwise("other").alias("speaker"),
        F.col("o_orderkey").alias("cand_id"), F.col("o_totalprice").alias("score"),
    )
    return ev.pick_quota(cand, [(4, 2), (3, 3), (2, 4)], "host", "guest").select("episode", "speaker", "cand_id", "rank")


_CRITERIA = list(ev.INSERT_WEIGHTS)


@query("ag21_rubric_score", """with s as (select p_partkey as item, unnest(range(7)) as k, p_size from part), x as (select item, k, 2+(item*(k+3)+p_size)%4 as score from s),
    t as (select item, round(sum(score*[0.30,0.20,0.15,0.15,0.10,0.05,0.05][k+1]::double),6) as total, max(score) filter (k=0) as claim, max(score) filter (k=6) as lic from x group by 1)
    select item, total, total>=4 and claim>=4 and lic>=5 as approved from t""")
def ag21(spark, d):
    names = F.array(*[F.lit(c) for c in _CRITERIA])
    scores = table(spark, d, "part").select("p_partkey", "p_size", F.posexplode(names).alias("k", "criterion")).select(
        F.col("p_partkey").alias("item"), "criterion", (F.lit(2) + (F.col("p_partkey") * (F.col("k") + 3) + F.col("p_size")) % 4).alias("score")
    )
    return ev.rubric_score(scores, ev.INSERT_WEIGHTS, ev.INSERT_GATES, ev.INSERT_PASS)


@query("ag22_session_cost", f"""with {TURN_SQL}, e as (select session, 'r'||target as target, min(idx) as a, max(idx) as b from turns where target in (1,4) group by 1,2)
    select e.session, e.target, b-a+1 as turns, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_read) as bigint) as cache_read, count(*) filter (is_read) as images, count(*) filter (not is_read) as commands,
      round((epoch_us(max(ts))-epoch_us(min(ts)))/60e6,3) as minutes from e join turns t on t.session=e.session and t.idx between a and b group by 1,2,3""")
def ag22(spark, d):
    return ev.session_cost(logs.parse_turns(session_lines(spark, d)), ["r1", "r4"])
