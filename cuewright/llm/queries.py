"""Named queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import table
from cuewright.llm.cotraining import score_quality
from cuewright.llm.decontamination import find_leaks
from cuewright.llm.html_extract import extract_text
from cuewright.llm.jaccard_join import jaccard_groups
from cuewright.llm.lexical_search import rank_documents
from cuewright.llm.mixing import mix_counts
from cuewright.llm.negatives import mine_negatives
from cuewright.llm.pii import find_personal_data
from cuewright.llm.quality_rules import judge_documents
from cuewright.llm.sharding import SHARDS, shard_plan
from cuewright.llm.simhash_dedup import near_duplicates
from cuewright.llm.toxicity import score_toxicity
from cuewright.llm.url_filter import filter_urls
from cuewright.plans.registry import Query


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"), "best_p")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_verdict"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"))
    drawn = F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["shard"].cast("string"), s["words"].cast("string"))), ",")
    return mixed.withColumn("shards", drawn)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", "threshold")


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_plan(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


OP11_SQL = """
with quantised as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label,
    list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from quantised a join quantised r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id and len(a.v) = len(r.v)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
  (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 5
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
with tokens as (select doc_id, unnest({_TERMS}) as term from documents),
lengths as (select doc_id, count(*) as n from tokens group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as words from lengths),
tf as (select doc_id, term, count(*) as tf from tokens group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1)))::bigint as w
  from tf, totals group by term, docs),
wanted as (select item_id, unnest({_TERMS}) as term from benchmark),
asked as (select item_id, term, count(*) as times from wanted group by item_id, term),
norms as (select doc_id, 75 + (25 * n * docs) // words as m from lengths, totals),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join weights using (term) join tf using (term) join norms using (doc_id)
  group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle from places),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as joint
  from shingles x join shingles y using (shingle) group by x.doc_id, y.doc_id),
links as (
  select a, b from common join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b
  where 100 * joint >= 80 * (sa.n + sb.n - joint)),
reached as (
  select doc_id, doc_id as other from sizes
  union
  select reached.doc_id, links.b from reached join links on links.a = reached.other),
groups as (select doc_id, min(other) as least from reached group by doc_id)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(g.least, d.doc_id) as component_id
from documents d left join sizes s using (doc_id) left join groups g using (doc_id)
"""


def llm_queries() -> dict[str, Query]:
    import corpus_pipeline

    return {
        "op1_decontamination": Query(op1_decontamination, None),
        "op2_pii": Query(op2_pii, None),
        "op3_simhash_golay": Query(op3_simhash_golay, None),
        "op4_toxicity": Query(op4_toxicity, None),
        "op5_quality_rules": Query(op5_quality_rules, None),
        "op6_mixing": Query(op6_mixing, None),
        "op7_url_filter": Query(op7_url_filter, None),
        "op8_cotraining": Query(op8_cotraining, None),
        "op9_sharding": Query(op9_sharding, None),
        "op10_html_extraction": Query(op10_html_extraction, None),
        "op11_hard_negatives": Query(op11_hard_negatives, OP11_SQL),
        "op12_lexical_search": Query(op12_lexical_search, OP12_SQL),
        "op13_jaccard_join": Query(op13_jaccard_join, OP13_SQL),
        "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
