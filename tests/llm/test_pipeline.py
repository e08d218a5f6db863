"""The pipeline's stages against plain versions, each on its own input, and on odd rows."""

from collections import Counter

import corpus_pipeline
from test_documents import plain_components, plain_counts, plain_fingerprint, plain_leaks
from test_native import plain_targets

SF = "/root/testdata/sf0.001"


def kept(counts):
    n, chars, symbols, dup, repeated = counts
    words = max(1, n)
    soft = symbols / words > 0.1 or dup / words > 0.05 or not 2 <= chars / words <= 20
    return not (n < 10 or 100 * repeated > 20 * n or soft)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    now = stages["quality"](spark, docs, SF).cache()
    left = {d for d, r in rows.items() if kept(plain_counts(r.text))}  # every host is mixed here
    assert {r.doc_id for r in now.collect()} == left and now.columns == docs.columns

    now = stages["near_duplicates"](spark, now, SF).cache()
    groups = plain_components({d: plain_fingerprint(rows[d].text) for d in left})
    left = {d for d in left if groups[d] == d}
    assert {r.doc_id for r in now.collect()} == left and now.columns == docs.columns

    now = stages["decontamination"](spark, now, SF).cache()
    left -= {d for d, _ in plain_leaks([(d, rows[d].text) for d in left], items)}
    assert {r.doc_id for r in now.collect()} == left and now.columns == docs.columns

    size = Counter()
    for d in left:
        size[rows[d].source] += len(rows[d].text.split())
    now = stages["mixing"](spark, now, SF).cache()
    assert now.columns == docs.columns
    taken = Counter()
    for r in now.collect():
        taken[r.source] += len(r.text.split())
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= 64 for s in size)

    out = stages["sharding"](spark, now, SF).collect()
    shards = Counter(r.shard for r in out)
    assert len(out) == now.count() and max(shards.values()) - min(shards.values()) <= 1
    again = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in out) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != "sharding":
                assert now.columns == docs.columns
        assert now.count() >= 0
    assert no_docs.count() == 0
