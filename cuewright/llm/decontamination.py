"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact verification."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import map_rows

#: Words per shingle, lowest weighted similarity, Hamming radius of the fingerprint search.
SHINGLE, SIMILARITY, HAMMING = 5, 0.8, 19
#: Benchmark items in one index; more items take more passes over the documents.
ITEMS_PER_PASS = 2000
_BLOCKS, _WIDTH, _SPAN = 4, 16, 16384
#: Words are runs of letters and digits, lower-cased; any character outside ASCII counts as a letter.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

HIT = "item_id bigint, similarity double, first_word bigint, window_words bigint"


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.lower().encode("utf-8", "replace")) if text else []


class _WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hash = _WordHashes()
#: Odd multipliers: one for each word of a shingle, by its place, and two of a bit mixer.
_PLACES = np.array([2 * xxhash.xxh64_intdigest(bytes([i])) + 1 & (1 << 64) - 1 for i in range(SHINGLE + 2)], np.uint64)


def hashes_of(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit hash of each shingle of ``width`` words; of the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += h[i : i + n] * _PLACES[i]
    for m in _PLACES[SHINGLE:]:
        out ^= out >> np.uint64(31)
        out *= m
    return out ^ (out >> np.uint64(29))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of each shingle."""
    both, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(n[: len(a)], minlength=len(both)), np.bincount(n[len(a) :], minlength=len(both))
    return float(np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())


class Index:
    """Benchmark items by length and fingerprint block.

    64 bits are four blocks of 16; two fingerprints within 19 bits agree within 4 bits in one block,
    so each item is listed under every value within 4 bits of each of its blocks.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.hashes, self.words = [], [], []
        for key, text in items:
            if words := words_of(text):
                self.ids.append(key)
                self.hashes.append(hashes_of(words))
                self.words.append(len(words))
        self.known = np.unique(np.concatenate([*self.hashes, np.empty(0, np.uint64)]))
        self.lengths = np.array(self.words, np.int64)
        self.sizes = sorted(set(self.words))
        #: By size and known shingle: does an item of that size hold it?
        self.holds = {size: np.zeros(len(self.known), bool) for size in self.sizes}
        for h, size in zip(self.hashes, self.words):
            self.holds[size][np.searchsorted(self.known, h)] = True
        self.fps = np.array([_packed((2 * _bits(h).sum(0, dtype=np.int64) > len(h))[None])[0] for h in self.hashes], np.uint64)
        near = np.array([sum(1 << i for i in c) for k in range(HAMMING // _BLOCKS + 1) for c in combinations(range(_WIDTH), k)], np.int64)
        self.keys, self.rows = [], []
        for b in range(_BLOCKS):
            value = ((self.fps >> np.uint64(_WIDTH * b)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
            keys = ((self.lengths << _WIDTH)[:, None] | (value[:, None] ^ near)).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.rows.append(np.repeat(np.arange(len(value)), len(near))[order])

    def candidates(self, fps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all items of that length within the radius."""
        wins, items = [], []
        for b in range(_BLOCKS):
            key = ((fps >> np.uint64(_WIDTH * b)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64) | (length << _WIDTH)
            lo, hi = np.searchsorted(self.keys[b], key, "left"), np.searchsorted(self.keys[b], key, "right")
            n = hi - lo
            if n.any():
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                wins.append(np.repeat(np.arange(len(fps)), n))
                items.append(self.rows[b][at])
        if not wins:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, i = np.concatenate(wins), np.concatenate(items)
        near = np.bitwise_count(fps[w] ^ self.fps[i]) <= HAMMING
        pairs = np.unique(np.stack([w[near], i[near]]), axis=1)
        return pairs[0], pairs[1]

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Best window of each contained item: (item, similarity, first word, words)."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        if words and len(self.known):
            for width in sorted({min(s, SHINGLE) for s in self.sizes}):
                sizes = [s for s in self.sizes if min(s, SHINGLE) == width]
                self._search(words, hashes_of(words, width), width, sizes, best)
        return [(self.ids[i], *best[i]) for i in sorted(best)]

    def _search(self, words: list[bytes], hashes: np.ndarray, width: int, sizes: list[int], best: dict[int, tuple[float, int, int]]) -> None:
        """Adds the best windows of all items of the given sizes, whose shingles have ``width`` words."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == hashes)
        for size in sizes if len(hits) else ():
            window = min(size, len(words))
            n = max(1, window - width + 1)
            # a window without a shingle of an item has similarity 0 to it, so the others are enough
            mine = hits[self.holds[size][at[hits]]]
            first = np.unique((mine[:, None] - np.arange(n)).ravel())
            first = first[(first >= 0) & (first <= len(hashes) - n)]
            while len(first):
                part, first = np.split(first, [np.searchsorted(first, first[0] + _SPAN)])
                begin = part[0]
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[begin : part[-1] + n]), axis=0, dtype=np.int32)])
                fps = _packed(2 * (sums[part - begin + n] - sums[part - begin]) > n)
                for w, i in zip(*self.candidates(fps, size)):
                    s = int(part[w])
                    sim = weighted_jaccard(hashes[s : s + n], self.hashes[i])
                    if sim >= SIMILARITY and (i not in best or (sim, -s) > (best[i][0], -best[i][1])):
                        best[i] = (sim, s, window)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str | None]]]:
    """Items in groups of at most ``ITEMS_PER_PASS``, read part by part; a benchmark does not grow with the corpus."""
    items = [(r[0], r[1]) for r in benchmark.select(id_col, text_col).toLocalIterator()]
    return [items[i : i + ITEMS_PER_PASS] for i in range(0, len(items), ITEMS_PER_PASS)]


class _Lazy:
    """An index built once in each Python worker from the items of its group."""

    built: dict[int, Index] = {}

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = items
        self.mark = xxhash.xxh64_intdigest(repr(items).encode())

    def get(self) -> Index:
        if self.mark not in _Lazy.built:
            _Lazy.built.clear()
            _Lazy.built[self.mark] = Index(self.items)
        return _Lazy.built[self.mark]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each benchmark item that a document contains: id, ``item_id``, ``similarity``, ``first_word``,
    ``window_words`` (its best window; among equals the first).

    Windows have as many words as the item (the whole document, where it is shorter). A window's
    SimHash is compared with items of that size through a multi-index that yields every fingerprint
    within ``HAMMING`` bits; a candidate counts at a weighted shingle similarity of ``SIMILARITY``
    or more. Items of fewer than five words are one shingle. Null and empty texts contain nothing
    and are contained nowhere; repeated documents and items give repeated rows; empty tables none.
    """
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    out = None
    for items in _indexes(benchmark, item_col, item_text):
        index = _Lazy(items)

        def run(columns: list[list], index: _Lazy = index) -> list[list]:
            found = index.get()
            return [[[(int(k), s, f, w) for k, s, f, w in found.search(t)] or None for t in columns[0]]]

        hits = map_rows(lean, ["_t"], ["_id"], f"_hits array<struct<{HIT.replace(' bigint', ':bigint').replace(' double', ':double')}>>", run)
        hits = hits.select(F.col("_id").alias(id_col), F.explode("_hits").alias("_h")).select(id_col, "_h.*")
        out = hits if out is None else out.union(hits)
    if out is None:
        out = lean.select(F.col("_id").alias(id_col), *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in HIT.split(", ")]).limit(0)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, with their columns."""
    full = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_t"))
    for items in _indexes(benchmark, item_col, item_text):
        index = _Lazy(items)

        def run(columns: list[list], index: _Lazy = index) -> list[list]:
            found = index.get()
            return [[not found.search(t) for t in columns[0]]]

        full = map_rows(full, ["_t"], ["_doc", "_t"], "_clean boolean", run).filter("_clean").drop("_clean")
    return full.select("_doc.*")
