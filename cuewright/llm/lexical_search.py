"""Ranked lexical search by two trees: hierarchies over items and over documents, met from the top.

A node keeps, per term, the greatest weight of any of its items or documents. The product of two nodes
bounds every score below them; a pair whose bound is under the weakest k-th score of the items below is left
out with all it holds. Leaf pairs that remain are scored exactly.

Texts are read once: what is written is, per document, its length and the frequencies of the items' terms.
Trees are built in the tasks, over one block of documents and one pack of items at a time. The items' first
k-th scores come from a sample of blocks; a bound from below stays one in all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, dealt, map_rows, meet_blocks

TOP = 20
BLOCK_ROWS, SEED_BLOCKS = 4096, 4
ITEM_LEAF, DOC_LEAF, FANOUT = 8, 16, 8
PACK_ITEMS, PACK_TERMS, NODE_CELLS = 256, 16_384, 1 << 22
#: Documents keep only the items' terms while there are at most so many of them (all terms beyond).
VOCABULARY = 1_000_000

#: Fixed by the contract: ASCII letters and digits and everything beyond ASCII make terms; only A-Z is lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _count_terms(vocabulary: dict[bytes, int] | None):
    def run(columns: list[list]) -> list[list]:
        lengths, hashes, counts = [], [], []
        for text in columns[0]:
            terms = terms_of(text)
            found = Counter(terms)
            if vocabulary is None:
                pairs = [(_hash(t), n) for t, n in found.items()]
            else:
                pairs = [(vocabulary[t], found[t]) for t in found.keys() & vocabulary.keys()]
            lengths.append(len(terms))
            hashes.append([h for h, _ in pairs])
            counts.append([n for _, n in pairs])
        return [lengths, hashes, counts]

    return run


class Block:
    """Documents of a block: ids, places in id order (nulls last), and their terms."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("_id").combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.place = np.empty(len(self.ids), np.int64)
        self.place[np.lexsort((self.ids, self.null))] = np.arange(len(self.ids))
        hashes, counts = table.column("h").combine_chunks(), table.column("n").combine_chunks()
        self.h = hashes.flatten().to_numpy()
        per = hashes.value_lengths().to_numpy()
        self.doc = np.repeat(np.arange(len(per)), per)
        tf = counts.flatten().to_numpy()
        m = table.column("m").combine_chunks().to_numpy()[self.doc]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _levels(leaf: np.ndarray) -> list[np.ndarray]:
    """Maxima per node, leaves first, up to one root."""
    out = [leaf]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))
    return out


class Search:
    """One pack of items against one block."""

    def __init__(self, block: Block, items: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], k: int) -> None:
        self.k, self.block = k, block
        self.floor = np.array([f for *_, f in items], np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)
        vocabulary, first = np.unique(np.concatenate([h for h, *_ in items]), return_index=True)
        weights = np.concatenate([w for _, _, w, _ in items])[first]
        rows = np.repeat(np.arange(len(items)), [len(h) for h, *_ in items])
        times = np.concatenate([t for _, t, _, _ in items])
        columns = np.searchsorted(vocabulary, np.concatenate([h for h, *_ in items]))
        at = np.minimum(np.searchsorted(vocabulary, block.h), len(vocabulary) - 1)
        known = vocabulary[at] == block.h
        doc, term = block.doc[known], at[known]
        cost = weights[term] * block.impact[known]
        largest = int(cost.max(initial=0)) * int(np.bincount(rows, weights=times, minlength=1).max(initial=0))
        self.kind = np.float64 if largest < 1 << 53 else np.int64
        self._items(rows, columns, times, weights, len(items), len(vocabulary))
        self._documents(doc, term, cost, len(vocabulary))

    def _items(self, rows: np.ndarray, columns: np.ndarray, times: np.ndarray, weights: np.ndarray, n: int, width: int) -> None:
        heaviest = np.zeros(n, np.int64)  # items with the same rarest term become neighbours
        order = np.lexsort((weights[columns], rows))
        heaviest[rows[order]] = columns[order]
        self.item_at = np.argsort(heaviest, kind="stable")
        self.dense = np.zeros((n, width), self.kind)
        self.dense[np.argsort(self.item_at)[rows], columns] = times
        self.item_nodes = _levels(np.maximum.reduceat(self.dense, np.arange(0, n, ITEM_LEAF), axis=0))

    def _documents(self, doc: np.ndarray, term: np.ndarray, cost: np.ndarray, width: int) -> None:
        n = len(self.block.ids)
        heaviest = np.full(n, width, np.int64)
        order = np.lexsort((cost, doc))
        heaviest[doc[order]] = term[order]
        self.doc_at = np.argsort(heaviest, kind="stable")
        doc = np.argsort(self.doc_at)[doc]
        self.leaf = max(DOC_LEAF, -(-n * width // NODE_CELLS))
        leaves = -(-n // self.leaf)
        order = np.lexsort((term, doc // self.leaf))
        cells = (doc // self.leaf * width + term)[order]
        leaf = np.zeros(leaves * width, self.kind)
        if len(cells):
            begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            leaf[cells[begin]] = np.maximum.reduceat(cost[order], begin)
        self.doc_nodes = _levels(leaf.reshape(leaves, width))
        order = np.argsort(doc, kind="stable")
        self.doc, self.term, self.cost = doc[order], term[order], cost[order].astype(self.kind)
        self.begin = np.searchsorted(self.doc, np.arange(n + 1))

    def _least(self, item: int) -> int:
        scores, _ = self.best[item]
        return max(int(self.floor[item]), int(scores[-1]) if len(scores) == self.k else 0, 1)

    def _weakest(self, level: int, node: int) -> int:
        span = ITEM_LEAF * FANOUT**level
        return min(self._least(i) for i in self.item_at[node * span : (node + 1) * span])

    def _kept(self, item_level: int, node: int, doc_level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the document nodes an item node still has to meet, and the bounds."""
        row = self.item_nodes[item_level][node]
        terms = np.flatnonzero(row)
        bound = self.doc_nodes[doc_level][np.ix_(nodes, terms)] @ row[terms]
        stay = bound >= self._weakest(item_level, node)
        return nodes[stay], bound[stay]

    def run(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per item: scores and rows of its best documents in the block, best first."""
        i, d = len(self.item_nodes) - 1, len(self.doc_nodes) - 1
        front = {0: np.zeros(1, np.int64)}
        while True:
            met = {q: self._kept(i, q, d, nodes) for q, nodes in front.items()}
            if not i and not d:
                break
            front = {q: nodes for q, (nodes, _) in met.items() if len(nodes)}
            if d:
                d -= 1
                n = len(self.doc_nodes[d])
                front = {q: (c := (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel())[c < n] for q, nodes in front.items()}
            if i:
                i -= 1
                n = len(self.item_nodes[i])
                front = {c: nodes for q, nodes in front.items() for c in range(q * FANOUT, min(n, (q + 1) * FANOUT))}
        for q, (nodes, bound) in met.items():
            self._leaves(q, nodes, bound)
        out: list = [None] * len(self.best)
        for item, (scores, rows) in enumerate(self.best):
            out[item] = scores, self.doc_at[rows]
        return out

    def _leaves(self, q: int, nodes: np.ndarray, bound: np.ndarray) -> None:
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        weights = self.dense[q * ITEM_LEAF : (q + 1) * ITEM_LEAF]
        items = self.item_at[q * ITEM_LEAF : (q + 1) * ITEM_LEAF]
        at, step = 0, 4
        while at < len(nodes) and bound[at] >= self._weakest(0, q):
            part = np.sort(nodes[at : at + step])
            docs = (part[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            docs = docs[docs < len(self.doc_at)]
            docs = docs[self.begin[docs] < self.begin[docs + 1]]
            at, step = at + step, min(64, step * 2)
            if not len(docs):
                continue
            sizes = self.begin[docs + 1] - self.begin[docs]
            ends = np.cumsum(sizes)
            rows = np.arange(ends[-1]) + np.repeat(self.begin[docs] - (ends - sizes), sizes)
            scores = np.add.reduceat(weights[:, self.term[rows]] * self.cost[rows], ends - sizes, axis=1).astype(np.int64)
            for item, row in zip(items.tolist(), scores):
                hit = np.flatnonzero(row >= self._least(item))
                if len(hit):
                    score = np.concatenate([self.best[item][0], row[hit]])
                    doc = np.concatenate([self.best[item][1], docs[hit]])
                    first = np.lexsort((self.block.place[self.doc_at[doc]], -score))[: self.k]
                    self.best[item] = score[first], doc[first]


def _packs(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[tuple]]]:
    numbers, items, terms = [], [], 0
    columns = [batch.column(c) for c in ("q_h", "q_times", "q_weight")]
    for i, (number, floor) in enumerate(zip(batch.column("item").to_pylist(), batch.column("floor").to_pylist())):
        h, times, weight = (c[i].values.to_numpy() for c in columns)
        if items and (len(items) >= PACK_ITEMS or terms + len(h) > PACK_TERMS):
            yield numbers, items
            numbers, items, terms = [], [], 0
        numbers.append(number)
        items.append((h, times, weight, floor))
        terms += len(h)
    if items:
        yield numbers, items


def _answer(k: int):
    def answer(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for numbers, items in _packs(batch):
            for number, (scores, rows) in zip(numbers, Search(block, items, k).run()):
                if len(rows):
                    ids = pa.array(block.ids[rows], mask=block.null[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int64)), ids, pa.array(scores)], ["item", "doc", "score"])

    return answer


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
    block_rows: int = BLOCK_ROWS,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """The ``k`` best documents with a score above 0 for each item: ``item id, rank, document id, score``.

    A document's score for an item sums, over the item's terms with repeats, w * ((10**9 tf) div (1000 tf + 12 m)),
    where w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L, all but w in 64-bit integers.
    Equal scores go by ascending id (nulls last). Null and empty texts have no terms: such documents are in
    no count and no result, such items have no rows. Repeated document rows are ranked one by one; repeated
    item rows (equal id and text) are one item, and rows that share an id only are items of their own.
    Empty tables give no rows.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("_t")).filter("_t is not null").distinct()
    asked = cut_lineage(asked).withColumn("item", F.monotonically_increasing_id())  # of a written table
    terms = map_rows(asked, ["_t"], ["item"], "term array<binary>, times array<bigint>", _item_terms)
    terms = cut_lineage(terms.select("item", F.explode(F.arrays_zip("term", "times")).alias("_z")).select("item", "_z.*"))
    distinct = terms.select("term").distinct()
    known = None
    if distinct.count() <= vocabulary:
        known = {bytes(r[0]): _hash(bytes(r[0])) for r in distinct.collect()}
    lean = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    found = cut_lineage(map_rows(lean, ["_t"], ["_id"], "length bigint, h array<bigint>, n array<bigint>", _count_terms(known)).filter("length > 0"))
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    m = F.expr(f"75 + cast((cast(length as decimal(20, 0)) * cast({25 * n} as decimal(18, 0))) div {max(total, 1)} as bigint)")
    placed, blocks = dealt(found.select("_id", "h", "n", m.alias("m")), block_rows)
    df = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    words = map_rows(terms, ["term"], ["item", "times"], "h bigint", lambda c: [[_hash(t) for t in c[0]]])
    weighed = words.join(df, "h").withColumn("weight", F.floor(1000 * F.log((F.lit(2.0 * n) + 2) / (2 * F.col("df") + 1))).cast("long"))
    queries = weighed.groupBy("item").agg(F.collect_list(F.struct("h", "times", "weight")).alias("_z"))
    queries = cut_lineage(queries.select("item", *[F.col(f"_z.{c}").alias(f"q_{c}") for c in ("h", "times", "weight")]))
    kinds = "item bigint, doc bigint, score bigint"
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))

    def search(rows: DataFrame, over: int, floor: DataFrame) -> DataFrame:
        hits = meet_blocks(rows, floor, over, kinds, Block, _answer(k))
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    none = queries.withColumn("floor", F.lit(0).cast("long"))
    if blocks > SEED_BLOCKS:
        seeds = search(placed.filter(F.col("_block") < SEED_BLOCKS), SEED_BLOCKS, none)
        floor = seeds.filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
        none = cut_lineage(queries.join(floor, "item", "left").fillna(0, ["floor"]))
    ranked = search(placed, blocks, none).join(asked.select("item", "item_id"), "item")
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _item_terms(columns: list[list]) -> list[list]:
    counted = [Counter(terms_of(t)) for t in columns[0]]
    return [[list(c) for c in counted], [list(c.values()) for c in counted]]
