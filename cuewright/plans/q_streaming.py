"""The streaming definitions evaluated over the whole event table.

Each definition works on a stream and on a table; here the table answers, so that the result can
be compared. The tests drive the same definitions as streams.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import gates
from cuewright.plans import bindings as B
from cuewright.plans.bindings import with_
from cuewright.plans.q_captions import QC_SQL
from cuewright.plans.registry import query
from cuewright.streaming import logs


@query("st1_stream_feedback", with_("feedback", "select date_trunc('day', ts)::timestamp as day, client, category, count(*) as n from feedback group by 1,2,3"))
def st1(spark, d):
    return logs.feedback_counts(B.feedback(spark, d))


@query("st3_stream_sessions", with_("feedback", """, h as (select client, ts, ts-lag(ts) over (partition by client order by ts)<interval 6 hour as joined from feedback where category='error'),
    g as (select *, sum(case when joined then 0 else 1 end) over (partition by client order by ts) as i from h)
    select client, min(ts) as first, max(ts) as last, count(*) as hits from g group by client, i"""))
def st3(spark, d):
    hits = B.feedback(spark, d).filter(F.col("category") == "error")
    return logs.keyword_sessions(hits, "21599 seconds 999 milliseconds")


@query("st2_caption_checks", QC_SQL + "select clip_id, seq, s, e, text, severity, code, duration, cps from finding")
def st2(spark, d):
    """Every clip arrives twice in the same version; the gate sees it once."""
    once = B.caption(spark, d).withColumn("hash", F.md5(F.concat_ws("/", "clip_id", "s", "e", "text")))
    return gates.caption_qc(logs.fresh_captions(once.unionByName(once)).drop("hash"))
