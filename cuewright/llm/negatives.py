"""Hard negatives by a vertical scan: dimensions in each anchor's order, candidates cut by bounds.

Vectors are integers (components scaled and rounded down). Blocks of them are kept by dimension. An
anchor reads dimensions in descending magnitude of its own components; what the unread ones can still
add lies between sums of products with each dimension's minimum and maximum in the block. Candidates
whose bounds rule them out leave the bitmap, until the rest is known exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, dealt, meet_blocks

SCALE, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 5, 5, 80
BLOCK_ROWS = 4096
STRIPES = (4, 8, 16, 32)


class Columns:
    """Vectors of one length, by dimension, in ascending id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.values = np.ascontiguousarray(vectors[order].T, dtype=np.int64)
        self.low, self.high = self.values.min(1), self.values.max(1)
        self.most = int(np.abs(self.values).max(initial=0))
        self.floats = self.values.astype(np.float64)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, settle: Callable[[np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``alive`` that are left, with their exact scores. ``settle`` gets the sums over the
        dimensions read and the least and most that the others add; it returns which rows stay."""
        small = int(np.abs(anchor).max(initial=0)) * self.most * max(1, len(anchor)) < 1 << 53
        values, kind = (self.floats, np.float64) if small else (self.values, np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least, most = np.append(np.minimum(*ends)[::-1].cumsum()[::-1], 0), np.append(np.maximum(*ends)[::-1].cumsum()[::-1], 0)
        score, at, weights = np.zeros(len(alive), kind), 0, anchor[order].astype(kind)
        for upto in [*(s for s in STRIPES if s < len(order)), len(order)]:
            part = values[order[at:upto]]
            score = score + weights[at:upto] @ (part if len(alive) == part.shape[1] else part[:, alive])
            stay = settle(score, int(least[upto]), int(most[upto]))
            alive, score, at = alive[stay], score[stay], upto
            if not len(alive):
                break
        return alive, score.astype(np.int64)

    def best(self, anchor: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest scores among ``alive``, ties by smaller id."""

        def settle(score: np.ndarray, least: int, most: int) -> np.ndarray:
            if len(score) <= k:
                return np.ones(len(score), bool)
            return score + most >= np.partition(score, len(score) - k)[len(score) - k] + least

        rows, score = self.scan(anchor, alive, settle)
        order = np.lexsort((rows, -score))[:k]
        return rows[order], score[order]

    def within(self, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows among the ``k`` highest of one of the windows (least and greatest score)."""

        def settle(score: np.ndarray, least: int, most: int) -> np.ndarray:
            low, high, stay = score + least, score + most, np.zeros(len(score), bool)
            for bottom, top in windows:
                inside = (high >= bottom) & (low <= top)
                sure = low[(low >= bottom) & (high <= top)]
                if len(sure) > k:
                    inside &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                stay |= inside
            return stay

        return self.scan(anchor, alive, settle)


def _build(parts: list[pa.RecordBatch]) -> dict[int, Columns]:
    ids = np.concatenate([p.column("_id").to_numpy() for p in parts])
    labels = np.concatenate([p.column("_label").to_numpy() for p in parts])
    vectors = [np.asarray(v, np.int64) for p in parts for v in _vectors(p)]
    sizes = np.array([len(v) for v in vectors])
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = Columns(ids[at], labels[at], np.stack([vectors[i] for i in at]).reshape(len(at), n))
    return out


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("_vector")
    return [s.values.to_numpy() for s in column]


def _positives(k: int):
    def answer(block: dict[int, Columns], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for anchor, label, vector in zip(batch.column("_id").to_pylist(), batch.column("_label").to_pylist(), _vectors(batch)):
            part = block.get(len(vector))
            if part is not None:
                alive = np.flatnonzero((part.labels == label) & (part.ids != anchor))
                rows, score = part.best(vector.astype(np.int64), alive, k)
                out += zip([anchor] * len(rows), part.ids[rows].tolist(), score.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["_id", "other", "score"])

    return answer


def _negatives(k: int, percent: int):
    def answer(block: dict[int, Columns], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        of = zip(batch.column("_id").to_pylist(), batch.column("_label").to_pylist(), _vectors(batch), batch.column("_positives").to_pylist())
        for anchor, label, vector, positives in of:
            part = block.get(len(vector))
            if part is None:
                continue
            windows = [(-(-percent * p["score"] // 100), p["score"]) for p in positives]
            open_windows = sorted({w for w in windows if w[0] <= w[1]})
            if not open_windows:
                continue
            rows, score = part.within(vector.astype(np.int64), np.flatnonzero(part.labels != label), open_windows, k)
            order = np.lexsort((rows, -score))
            rows, score = rows[order], score[order]
            for p, (bottom, top) in zip(positives, windows):
                hit = np.flatnonzero((score >= bottom) & (score <= top))[:k]
                out += zip([anchor] * len(hit), [p["other"]] * len(hit), [p["score"]] * len(hit), part.ids[rows[hit]].tolist(), score[hit].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["_id", "positive", "positive_score", "negative", "score"])

    return answer


def _first(df: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), other)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """One row per id: ``_id``, ``_label``, ``_vector``; without rows that take no part."""
    v = F.col(vector_col)
    limit = F.least(F.lit(float(1 << 30)), F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1)))).cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    use = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~odd
    whole = F.transform(v, lambda x: F.greatest(-limit, F.least(limit, F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    rows = vectors.filter(F.coalesce(use, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), F.struct(F.col(label_col).cast("long").alias("_label"), whole.alias("_vector")).alias("_row"))
    return rows.groupBy("_id").agg(F.min("_row").alias("_row")).select("_id", "_row.*")


def mine_negatives(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor (rows whose id meets the predicate ``anchors``) and each of its ``positives`` best rows of
    the same label, the ``negatives`` best rows of other labels that score between ``percent`` % of the
    positive's score and that score: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are exact integer products of components floor(scale * x); equal scores go by smaller id. Rows
    with a null id, label or vector, or a null or non-finite component take no part. Of several rows with
    one id, the least (label, then vector) counts. Vectors meet those of their own length only.
    Components beyond plus or minus sqrt(2**62 / length), at most 2**30, count as that limit, so every
    score fits 64 bits. A negative positive score leaves an empty window. No rows or anchors: no result.
    """
    rows = cut_lineage(_integers(vectors, id_col, vector_col, label_col, scale))
    asked = rows.filter(anchors(F.col("_id")))
    placed, blocks = dealt(rows, block_rows)
    near = meet_blocks(placed, asked, blocks, "_id bigint, other bigint, score bigint", _build, _positives(positives))
    near = _first(near, ["_id"], "other", positives).groupBy("_id").agg(F.collect_list(F.struct("other", "score")).alias("_positives"))
    asked = cut_lineage(asked.join(near, "_id"))
    kinds = "_id bigint, positive bigint, positive_score bigint, negative bigint, score bigint"
    far = meet_blocks(placed, asked, blocks, kinds, _build, _negatives(negatives, percent))
    return _first(far, ["_id", "positive"], "negative", negatives).select(
        F.col("_id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
