"""Sharding, mixing and URL filter against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cuewright.llm.common import numbered, permuted, word_count
from cuewright.llm.mixing import mix_counts, mix_documents, source_targets
from cuewright.llm.queries import op6_mixing, op7_url_filter, op9_sharding
from cuewright.llm.sharding import shard_plan, shard_rows
from cuewright.llm.url_filter import RULES, filter_urls

SF = "/root/testdata/sf0.001"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_permuted(x, n, key):
    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, math.ceil(n / a))
    while True:
        left, right = x // b, x % b
        for r in range(4):
            if r % 2:
                right = (right + spark_hash(f"{key}:{r}:{left}") % b) % b
            else:
                left = (left + spark_hash(f"{key}:{r}:{right}") % a) % a
        x = left * b + right
        if x < n:
            return x


def spark_hash(s):
    return signed(xxhash.xxh64_intdigest(s.encode(), 42))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 5003])
def test_permutation(spark, n):
    got = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert all(r.p == plain_permuted(r.id, n, "k") for r in got)


def test_numbered_gives_all_numbers(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.lit(2).alias("m"))
    got = numbered(rows, ["g"], ["x"], "m").groupBy("g").agg(F.countDistinct("_rn").alias("d"), F.max("_rn").alias("n"), F.max("_off").alias("o")).collect()
    sizes = Counter(i % 3 for i in range(20_000))
    assert all(r.d == sizes[r.g] and r.n == sizes[r.g] - 1 and r.o == 2 * r.n for r in got)


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf  g", "a\u00a0b é\u2003x", None, "0" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_sharding(spark):
    rows = op9_sharding(spark, SF).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in op9_sharding(spark, SF).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_sharding_is_computable(spark):
    rows = shard_plan(spark.read.parquet(f"{SF}/documents.parquet"), 24, "s").collect()
    for r in rows:
        p = plain_permuted(r.row_number, len(rows), "s")
        assert (r.shard, r.slot) == (p % 24, p // 24)


def test_sharding_odd_rows(odd_docs, no_docs):
    rows = shard_rows(odd_docs, 5).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == odd_docs.count()
    assert all(r["_doc"]["size"] == 1 and r["_doc"]["_doc"] == "d" for r in rows)
    assert {r["size"] for r in rows if r["_doc"]["text"] is None} == {8}
    assert shard_rows(no_docs, 5).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_ = float(sum(sizes.values())), set(order)
    target = {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 100, "d": 1, "e": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing(spark):
    rows = op6_mixing(spark, SF).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in op6_mixing(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.taken <= 3 * r["size"]
        size[d.source] += r["size"]
        taken[d.source] += r.taken
        target[d.source] = r.target
    want = plain_targets(size)
    for s in size:
        assert abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 64
    assert all(r.source_size == size[docs[r.doc_id].source] for r in rows)


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mix_counts(docs).collect()}
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    got = Counter()
    out = mix_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words = r.text.split()
        got[r.doc_id] += len(words)
        assert r.n_chars == len(r.text)
        at = iter(texts[r.doc_id])
        assert all(any(w == x for x in at) for w in words)  # in order
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_output_shards_are_a_multinomial_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = {r.doc_id: {s.shard: s.words for s in r.shards} for r in mix_counts(docs).collect()}
    taken = {r.doc_id: r.taken for r in mix_counts(docs).collect()}
    assert all(sum(v.values()) == taken[k] and min(v.values(), default=1) > 0 for k, v in drawn.items())
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    blocks, total = Counter(), Counter()
    for k, v in drawn.items():
        for shard, words in v.items():
            blocks[source[k], shard] += words / 64
            total[source[k]] += words / 64
    for s, n in total.items():  # squared deviations from equal shares, by their variance: about one each
        spread = sum((blocks[s, i] - n / 64) ** 2 for i in range(64)) / (n / 64)
        assert 64 - 6 * (2 * 64) ** 0.5 < spread < 64 + 6 * (2 * 64) ** 0.5
    got = Counter()
    for r in mix_documents(docs, shard_col="part").collect():
        got[r.doc_id, r.part] += len(r.text.split())
    assert got == {(k, s): n for k, v in drawn.items() for s, n in v.items()}


def test_mixing_odd_rows(odd_docs, no_docs):
    rows = mix_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 3 * r["size"] for r in rows) and all(r.taken == 0 for r in rows if r["size"] == 0)
    for s in {r.source_size for r in rows}:
        part = [r for r in rows if r.source_size == s]
        assert abs(sum(r.taken for r in part) - sum({r.target for r in part})) <= 64 * len({r.target for r in part})
    assert mix_counts(no_docs).count() == 0 and mix_documents(no_docs).count() == 0
    mixed = mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.filter("taken != 5 or size != 1").count() == 0


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", rest[cut.start() :] if cut else "")[0]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = [
    "http://a.org", "http://a.org/", "HTTP://A.ORG/x?y=/z", "https://x.example.org/es/5", "https://example.org/en/12?x", "https://example.org/en/2",
    "http://notexample.org/es/1", "http://b.com/fr/#x", "http://b.com/de/1", "http://b.com/en/1", "no scheme", "", None, "://", "x://h?q", "x://h#f/de/", "a://b://c/d", "http://É.com/fr/é", "http://net/de/",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1.0, "v") for i, u in enumerate([*URLS, URLS[0], None])], "page_id long, url string, score double, verdict string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate([*URLS, URLS[0], None]):
        host, path, best = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] if best else None)
        assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block")
    assert filter_urls(pages.limit(0)).count() == 0


def test_url_model_against_plain_version(spark):
    import hashlib

    sf = "/root/testdata/sf0.01"
    order, rows = 5, op7_url_filter(spark, sf).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    text, held, said = {}, {}, {}
    for u in set(urls.values()):
        host, path, best = plain_rule(u)
        s = "\x02" * order + host + path + "\x03"
        text[u], said[u] = s, best and best[0]
        held[u] = int(hashlib.md5(u.encode()).hexdigest()[0], 16) < 4
        if best and not held[u]:
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[best[0]][s[i - k : i]][(k, s[i])] += 1

    def prob(model, s, i):
        p = 1 / 256
        for k in range(order + 1):
            seen = {c: n for (j, c), n in model[s[i - k : i]].items() if j == k}
            n, t = sum(seen.values()), len(seen)
            if n:
                p = (seen.get(s[i], 0) + t * p) / (n + t)
        return p

    score = {u: sum(math.log(prob(counts["allow"], s, i)) - math.log(prob(counts["block"], s, i)) for i in range(order, len(s))) / (len(s) - order) for u, s in text.items()}
    part = {v: [score[u] for u in text if held[u] and said[u] == v] for v in ("allow", "block")}
    mean = {v: sum(x) / len(x) for v, x in part.items()}
    dev = {v: math.sqrt(sum((y - mean[v]) ** 2 for y in x) / len(x)) + 1e-6 for v, x in part.items()}
    threshold = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    assert len(rows) == len(urls)
    for r in rows:
        u = urls[r.page_id]
        assert abs(r.score - score[u]) < 1e-6 and abs(r.threshold - threshold) < 1e-6
        assert r.verdict == (said[u] or ("allow" if score[u] >= threshold else "block"))
