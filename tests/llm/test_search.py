"""Hard negatives, lexical search and the Jaccard join against plain versions on odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm.jaccard_join import Bounds, Shingles, combination_keys, jaccard_groups, parity_bitmap
from cuewright.llm.lexical_search import rank_documents, terms_of
from cuewright.llm.negatives import Columns, mine_negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """Sorted (id, size, component) of rows (id, text), null ids last."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (d, least.get(find(i))) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(odd_docs).collect()), key=str)
    assert got == plain_groups(rows)
    assert jaccard_groups(no_docs).count() == 0


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_jaccard_near_copies(spark, rare):
    """A hot group of near copies around one text, chains at the threshold, short texts, copies."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"x{rng.integers(40)}"
        rows.append((1000 - i, " ".join(words[rng.integers(0, 8) : 120 - rng.integers(0, 12)])))
    rows += [(2000 + i, " ".join(f"c{j}" for j in range(3 * i, 3 * i + 60))) for i in range(20)]
    rows += [(3000 + i, " ".join(f"s{j}" for j in range(i % 3, 4 + i))) for i in range(9)] + [(7, "One two"), (8, "one\ttwo"), (9, "two one")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()), key=str)
    assert got == plain_groups(rows)


@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), max_size=3), st.sets(st.integers(0, 60), max_size=4), st.sampled_from([75, 80, 90, 100]), st.integers(0, 4))
@settings(max_examples=500, deadline=None)
def test_linked_sets_share_a_key(x, gone, new, percent, rare):
    """Whatever the frequencies: linked sets have a key in common, pass the first filter, and differ in
    at least as many shingles as their bitmaps."""
    y = (x - gone) | new
    bounds, both = Bounds(percent), len(x & y)
    if x == y or not y or not bounds.linked(both, len(x) + len(y)):
        return
    df = {h: 2 + (h * 7) % 5 for h in x & y} | {h: 1 + (h * 3) % 6 for h in x ^ y}
    keys, prefixes = [], []
    for s in (x, y):
        h = np.array(sorted(s), np.int64)
        f = np.array([df[v] for v in h.tolist()])
        keys.append(set(combination_keys(len(h), f[f > 1], h[f > 1], bounds, rare).tolist()))
        prefixes.append(set(h[: bounds.prefix(len(h))].tolist()))
    assert keys[0] & keys[1]
    assert len(prefixes[0] & prefixes[1]) >= max(bounds.shared(len(x)), bounds.shared(len(y)))
    a, b = (parity_bitmap(np.array(sorted(s), np.int64) << 41) for s in (x, y))
    assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(x ^ y)


@given(st.text("aAbé \t\n", max_size=60), st.text("aAbé \t\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_shingles(left, right):
    made = Shingles()
    x, y = (made.of(t.encode()) for t in (left, right))
    assert (len(x), len(y)) == (len(shingle_set(left)), len(shingle_set(right)))
    assert len(np.intersect1d(x, y)) == len(shingle_set(left) & shingle_set(right))


def plain_ranks(docs, items, k=20):
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(TERM.findall(lower(text)))
        scored = []
        for d, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, q in asked.items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block_rows", "vocabulary"), [(20, 4096, 1_000_000), (3, 40, 1_000_000), (5, 16, 0)])
def test_lexical_search(spark, small, k, block_rows, vocabulary):
    """Many blocks, seeded floors and an unfiltered vocabulary all give the plain ranking."""
    items = [(int(i), t) for i, t in enumerate(small.text[:12])] + [(50, None), (51, ""), (52, "the THE the ñ"), (52, "the THE the ñ"), (53, "zzzz")]
    docs = list(zip(small.doc_id.tolist(), small.text))
    docs += [(None, docs[3][1]), (None, None), (900, docs[3][1]), (900, docs[3][1]), (901, " \n"), (902, "é" * 100_000), (903, " ".join(t for _, t in docs[:80] if t))]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=k, block_rows=block_rows, vocabulary=vocabulary)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == plain_ranks(docs, items, k)


def test_lexical_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "plain document about rivers"), (None, "rivers and hills")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rank_documents(odd_docs, items).collect()), key=str)
    assert got == plain_ranks(docs, [(1, "plain document about rivers"), (None, "rivers and hills")])
    assert rank_documents(no_docs, items).count() == rank_documents(odd_docs, items.limit(0)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_terms(text):
    assert [t.decode() for t in terms_of(text.encode("utf-8", "replace"))] == TERM.findall(lower(text.encode("utf-8", "replace").decode()))


def plain_negatives(rows, every):
    least = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = (label, tuple(math.floor(256 * x) for x in v))
        least[i] = min(whole, least.get(i, whole))
    by_label, out = defaultdict(list), []
    for i, (label, v) in least.items():
        by_label[label].append((i, v))
    for a, (label, v) in least.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in least.items() if len(w) == len(v)}
        same = sorted((i for i in score if i != a and least[i][0] == label), key=lambda i: (-score[i], i))[:5]
        for p in same:
            fit = [i for i in score if least[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 100, 4096])
def test_negatives(spark, block_rows):
    """Ties, repeated ids, vectors of other lengths, nulls, non-finite and huge components."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 12)] if i % 3 else [float(x) for x in rng.integers(-1, 2, 12)], int(rng.integers(3))) for i in range(260)]
    rows += [(10, [0.5] * 12, 0), (10, [0.5] * 12, 0), (11, None, 1), (12, [None, 1.0], 1), (13, [float("nan")], 1), (14, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (15, [1.0] * 12, None)]
    rows += [(300, [1.0, 2.0], 0), (301, [1.0, 2.0], 0), (302, [1.0, 1.9], 1), (310, [], 0), (311, [], 0), (312, [], 1), (320, [3e5] * 12, 0), (321, [3e5] * 12, 0), (322, [3e5] * 11 + [2.9e5], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, score int")
    got = mine_negatives(df, lambda i: i % 10 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 10)
    assert mine_negatives(df.limit(0), lambda i: i % 10 == 0).count() == mine_negatives(df, lambda i: i < 0).count() == 0


def test_huge_components_are_limited(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [1e300, 1.0], 0), (2, [1e300, 0.5], 1)]
    got = mine_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lambda i: i == 0).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(1, 2)] and got[0].positive_score == (1 << 60) + 65536


@given(st.integers(1, 40), st.integers(1, 24), st.integers(1, 6), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_scan_is_exact(rows, width, k, random):
    values = np.array([[random.randint(-40, 40) for _ in range(width)] for _ in range(rows)], np.int64)
    anchor = np.array([random.randint(-40, 40) for _ in range(width)], np.int64)
    block = Columns(np.arange(rows), np.zeros(rows, np.int64), values)
    score = values @ anchor
    order = np.lexsort((np.arange(rows), -score))[:k]
    got = block.best(anchor, np.arange(rows), k)
    assert got[0].tolist() == order.tolist() and got[1].tolist() == score[order].tolist()
    windows = [(int(score.min()), int(np.median(score))), (int(np.median(score)), int(score.max()))]
    rows_left, exact = block.within(anchor, np.arange(rows), windows, k)
    assert (score[rows_left] == exact).all()
    for low, high in windows:
        inside = [i for i in np.lexsort((np.arange(rows), -score)).tolist() if low <= score[i] <= high][:k]
        assert set(inside) <= set(rows_left.tolist())
