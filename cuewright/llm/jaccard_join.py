"""N-gram Jaccard join: prefixes extended by token combinations, exact verification, linked groups.

A document is the set of its distinct word shingles. The way to its partners:

1. *Extended hash prefixes* discard documents without a chance. In any order of all shingles, sets at
   similarity t share their k smallest common shingles within the first s - ceil(t s) + k of each
   (s: the set's size). Only so many of every document's smallest hashes are shuffled; one that sees
   too few of them elsewhere has no partner.
2. *Combination keys.* The sets of the rest are ordered by rarity. If the first common shingle of a pair is
   rare, it lies in the first s - ceil(t s) + 1 of both: it is a key by itself. If it is frequent, all
   common shingles are frequent; the sets differ in at most D = (1 - t)/t * o shingles (o common), which
   cannot part all of the first D + 2 common ones, so two of these stand side by side among the frequent
   shingles of both sets: every such neighbouring pair up to position s - ceil(t s) + D + 2 is a key.
   Keys are linear in the set, where all pairs of a prefix would be quadratic.
3. *Verification in two rounds.* Each key's members meet one of them, the pivot; verified links form
   groups. Then only members outside a key's largest group meet the others, so a large group of near
   copies is never paired among itself. Sizes, unshared shingles and a parity bitmap bound the overlap
   inside the join; what passes is decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, map_rows, written
from cuewright.llm.simhash_dedup import components
from cuewright.operators.salting import attach

WIDTH, PERCENT = 5, 80
RARE = 16
BITMAP_LONGS = 16
#: Survivors of the first filter are broadcast to the texts up to this number (about 50 bytes each).
BROADCAST_ROWS = 1_000_000
_SEEN = 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 0x9E3779B97F4A7C1B
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Distinct word shingles of whole texts as sorted 64-bit hashes.

    The hash of a shingle is a polynomial over its bytes, read off prefix sums of the text, so its
    cost does not depend on the width; an odd step has an inverse modulo 2**64.
    """

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.translate(_LOWER).split() if text else []  # splits at space, tab, LF, VT, FF, CR
        if not words:
            return np.empty(0, np.uint64)
        joined = np.frombuffer(b" ".join(words), np.uint8)
        self._powers(len(joined) + 1)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTES[joined] * self.up[: len(joined)], out=sums[1:])
        gaps = np.flatnonzero(joined == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(joined)]])
        n = max(1, len(words) - self.width + 1)
        a, b = starts[:n], ends[-n:]
        h = (sums[b] - sums[a]) * self.down[a]
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return np.unique(h ^ (h >> np.uint64(33)))


class Bounds:
    """Arithmetic of the threshold ``percent`` / 100 (75 to 100)."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 75 <= percent <= 100:
            raise ValueError("percent must be between 75 and 100")
        self.percent = percent

    def least(self, s: int) -> int:
        """Least overlap of a set of ``s`` with any partner, and the least size of a partner."""
        return -(-self.percent * s // 100)

    def _extra(self, s: int) -> int:
        return min(3 + s // 20, self.least(s))

    def prefix(self, s: int) -> int:
        return s - self.least(s) + self._extra(s)

    def shared(self, s: int) -> int:
        """So many of its prefix a set shares with the prefix of any partner."""
        return self._extra(self.least(s))

    def single(self, s: int) -> int:
        return s - self.least(s) + 1

    def paired(self, s: int) -> int:
        return s - self.least(s) + s * (100 - self.percent) // self.percent + 2

    def linked(self, overlap: int, total: int) -> bool:
        """``total``: sum of both sizes."""
        return 100 * overlap >= self.percent * (total - overlap)

    def possible(self, total: Column, apart: Column) -> Column:
        """Could sets of that total size link when at least ``apart`` shingles are in one of them only?"""
        return (100 + self.percent) * (total - apart) >= 2 * self.percent * total


def _signatures(width: int):
    def run(columns: list[list]) -> list[list]:
        made = Shingles(width)
        sizes, digests, nodes = [], [], []
        for text in columns[0]:
            h = made.of(text)
            d = xxhash.xxh3_128_digest(h.tobytes())
            sizes.append(len(h))
            digests.append(d)
            nodes.append(int.from_bytes(d[:8], "big", signed=True))
        return [sizes, digests, nodes]

    return run


def _prefix_tokens(width: int, bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = Shingles(width), {}
        for big in batches:
            for at in range(0, big.num_rows, 256):
                hs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for text in big.column(0).slice(at, 256).to_pylist():
                    h = made.of(text)
                    if len(h) < 2:
                        continue
                    node = int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "big", signed=True)
                    if node in seen:  # a copy: its tokens are on their way
                        continue
                    seen[node] = None
                    if len(seen) > _SEEN:
                        seen.pop(next(iter(seen)))
                    part = h[: bounds.prefix(len(h))]
                    hs.append(part)
                    nodes.append(np.full(len(part), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(nodes))], ["h", "node"])

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node) in order in; per batch, how many shingles each node shares with another."""
    kept_h, kept_node, again = np.empty(0, np.int64), np.empty(0, np.int64), False

    def out(nodes: np.ndarray) -> pa.RecordBatch:
        node, n = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64))], ["node", "n"])

    for batch in batches:
        h = np.concatenate([kept_h, batch.column(0).to_numpy()])
        node = np.concatenate([kept_node, batch.column(1).to_numpy()])
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node = h[new], node[new]
        same = h[1:] == h[:-1]
        shared = np.zeros(len(h), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= again
        yield out(node[:-1][shared[:-1]])
        kept_h, kept_node, again = h[-1:], node[-1:], bool(shared[-1])
    if again:
        yield out(kept_node)


def _full_sets(width: int):
    def run(columns: list[list]) -> list[list]:
        made = Shingles(width)
        return [[made.of(t).tobytes() for t in columns[0]]]

    return run


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            h = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), batch.column(0)[i].as_py(), np.int64))], ["h", "node"])


def combination_keys(size: int, df: np.ndarray, h: np.ndarray, bounds: Bounds, rare: int = RARE) -> np.ndarray:
    """Keys of a set of ``size`` whose shared shingles have the frequencies ``df`` and hashes ``h``."""
    order = np.lexsort((h, df))
    df, h = df[order], h[order].view(np.uint64)
    place = np.arange(size - len(h), size)  # shingles of this set alone come first
    single = h[(df <= rare) & (place < bounds.single(size))]
    often = h[(df > rare) & (place < bounds.paired(size))]
    joint = (often[:-1] * np.uint64(_STEP)) ^ (often[1:] >> np.uint64(7)) ^ (often[1:] << np.uint64(57))
    return np.unique(np.concatenate([single, joint])).view(np.int64)


def parity_bitmap(h: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    """Per bit, the parity of the number of shingles mapped to it: sets that differ in d shingles
    have bitmaps that differ in at most d bits."""
    bits = np.bincount((h.view(np.uint64) >> np.uint64(40)) % np.uint64(64 * longs), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _index(bounds: Bounds, rare: int):
    names = ["node", "size", "alone", "keys", *[f"b{i}" for i in range(BITMAP_LONGS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for node, size, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                pairs = shared.values
                df, h = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                rows.append([node, size, size - len(h), combination_keys(size, df, h, bounds, rare).tolist(), *parity_bitmap(h).tolist()])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * BITMAP_LONGS]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names)

    return run


def _verify(bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bounds.linked(both, len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(x: str, y: str) -> Column:
    """At least so many shingles are in only one of two indexed sets."""
    apart = F.col(f"{x}.alone") + F.col(f"{y}.alone")
    for i in range(BITMAP_LONGS):
        apart = apart + F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")))
    return apart


class _Join:
    """The search for links among the numbered sets of one run."""

    def __init__(self, sets: DataFrame, bounds: Bounds, rare: int) -> None:
        self.bounds, self.sets = bounds, sets
        tokens = sets.select("node", "set").mapInArrow(_explode_sets, "h bigint, node bigint")
        tokens = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("df > 1")
        shared = tokens.groupBy("node").agg(F.collect_list(F.struct("df", "h")).alias("shared"))
        shared = shared.join(sets.select("node", "size"), "node").select("node", "size", "shared")
        shared = shared.filter(100 * F.size("shared") >= bounds.percent * F.col("size"))
        kinds = "node bigint, size bigint, alone bigint, keys array<bigint>, " + ", ".join(f"b{i} bigint" for i in range(BITMAP_LONGS))
        self.nodes = cut_lineage(shared.mapInArrow(_index(bounds, rare), kinds))
        keys = self.nodes.select(F.explode("keys").alias("key"), "node", "alone")
        crowd = keys.groupBy("key").agg(F.min_by("node", F.struct("alone", "node")).alias("pivot"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        self.keys = cut_lineage(keys.drop("alone").join(crowd.drop("_n"), "key"))

    def _possible(self, x: str, y: str) -> Column:
        return self.bounds.possible(F.col(f"{x}.size") + F.col(f"{y}.size"), _apart(x, y))

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs a, b that link, decided on the whole sets."""
        left = self.sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(self.bounds), "a bigint, b bigint")

    def pivots(self) -> DataFrame:
        """Links of each key's pivot, the member with the fewest shingles of its own: of copies that
        were changed in different places, the one nearest to all of them."""
        near = self.keys.filter("pivot != node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        met = near.distinct().join(self.nodes.alias("x"), F.col("a") == F.col("x.node")).join(self.nodes.alias("y"), F.col("b") == F.col("y.node"))
        return self._linked(met.filter(self._possible("x", "y")).select("a", "b"))

    def others(self, roots: DataFrame) -> DataFrame:
        """Links between different groups (``node``, ``root``) that no pivot showed."""
        grouped = self.keys.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = grouped.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("_n", "root")).alias("main"), F.count(F.lit(1)).alias("_groups")).filter("_groups > 1")
        open_keys = grouped.join(largest.drop("_groups"), "key").join(self.nodes.drop("keys"), "node")
        x, y = open_keys.filter("root != main").alias("x"), open_keys.alias("y")
        fresh = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & fresh & self._possible("x", "y"))
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        return self._linked(pairs)


def _survivors(lean: DataFrame, rows: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    """One row (``sig``, ``size``, ``_id``, ``_th`` of one document) per set that may have partners."""
    tokens = lean.select("_t").mapInArrow(_prefix_tokens(width, bounds), "h bigint, node bigint")
    counts = tokens.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_count_shared, "node bigint, n bigint")
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    sets = rows.filter("n_shingles > 1").groupBy("sig").agg(F.min(F.struct("_id", "_th")).alias("_doc"), F.first("n_shingles").alias("size"), F.first("_node").alias("node"))
    least = F.ceil(F.lit(bounds.percent) * F.col("size") / 100)
    of_least = F.ceil(F.lit(bounds.percent) * least / 100)
    need = F.least(3 + F.floor(least / 20), of_least)
    return sets.join(counts, "node").filter(F.col("n") >= need).select("sig", "size", "_doc._id", "_doc._th")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """Per row: id, ``n_shingles`` (size of its set), ``component_id`` (smallest id reachable by links).

    Null texts, and texts without words, have an empty set and are linked with nothing; fewer words than
    ``width`` make one shingle. Texts with equal sets (copies, repeated rows) are one set from the start.
    Null ids count as the smallest only where a group has no other. An empty table gives no rows.
    """
    bounds = Bounds(percent)
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).withColumn("_th", F.xxhash64("_t"))
    rows = cut_lineage(map_rows(lean, ["_t"], ["_id", "_th"], "n_shingles bigint, sig binary, _node bigint", _signatures(width)))
    found = cut_lineage(_survivors(lean, rows, width, bounds)).withColumn("node", F.monotonically_increasing_id())  # of a written table
    few = found.select("node", "size", F.col("_id").alias("_fid"), F.col("_th").alias("_fth"))
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    texts = lean.join(few, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_th") == F.col("_fth"))).select("node", "size", "_t")
    sets = map_rows(texts, ["_t"], ["node", "size"], "`set` binary", _full_sets(width))
    sets = cut_lineage(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("set").alias("set")))
    join = _Join(sets, bounds, rare)
    links = written(join.pivots())
    roots = cut_lineage(components(links, written))
    links = links.unionByName(written(join.others(roots)))
    roots = components(links, written)
    groups = found.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    ids = rows.filter("n_shingles > 0").groupBy("sig").agg(F.min("_id").alias("least"))
    both = groups.join(ids, "sig")
    joint = both.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = both.join(joint, "root").select("sig", "component_id")
    ids = ids.join(moved, "sig", "left").select("sig", F.coalesce("component_id", "least").alias("component_id"))
    full = attach(rows.filter("n_shingles > 0"), ids, ["sig"], "left", salts=8).select("_id", "n_shingles", "component_id")
    empty = rows.filter("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("_id", id_col)
