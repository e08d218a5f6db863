"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import math
import string
import zlib
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import map_rows
from cuewright.llm.toxicity import held_out, labelled, logistic

#: Labelled and unlabelled documents that are learnt from at most (about; chosen by hash).
LABELLED, POOL = 5000, 5000
_HASHED = 1024
TEXT_DIMS, ROUNDS, CONFIDENT, PER_ROUND = _HASHED + 4, 5, 0.9, 0.1
_SOURCES, _LANGS, _MARKS = 32, 8, 14
META_DIMS = _SOURCES + _LANGS + _MARKS
_PIECE = 1 << 20


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed character-trigram shares of the whole text (UTF-8 bytes), and how much
    it repeats itself: distinct words, distinct word triples, compressed size, by length."""
    out = np.zeros(_HASHED)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = max(1, len(words))
    again = [len(set(words)) / n, len(set(zip(words, words[1:], words[2:]))) / n, len(zlib.compress(raw, 1)) / (len(raw) + 1), float(n > 30 and len(set(words)) < n / 3)]
    for at in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            out += np.bincount(((b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709) >> 3) % _HASHED, minlength=_HASHED)
    total = out.sum()
    return np.concatenate([np.sqrt(out / max(total, 1)), again]).astype(np.float32)


def meta_view(text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    """What is known about a document besides its wording: source, language, length, layout of its
    lines and shares of character classes."""
    text = text or ""
    out = np.zeros(META_DIMS, np.float32)
    out[xxhash.xxh32_intdigest("s" + (source or "")) % _SOURCES] = 1
    out[_SOURCES + xxhash.xxh32_intdigest("l" + (lang or "")) % _LANGS] = 1
    n, words, lines = len(text), text.count(" ") + 1, text.count("\n") + 1
    upper = sum(map(text.count, string.ascii_uppercase))
    marks = [
        math.log1p(n) / 10, math.log1p(words) / 10, math.log1p(lines) / 10, min(n / words, 40) / 40, min(words / lines, 400) / 400, upper / (n + 1),
        sum(map(text.count, "0123456789")) / (n + 1), sum(map(text.count, ".,;:")) / words, text.count("!") / words, text.count("|") / words,
        sum(map(text.count, "#*$%&")) / words, sum(map(text.count, "<>{}[]")) / words, float(n < 80), 1.0,
    ]
    out[_SOURCES + _LANGS :] = marks
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights (intercept last) of a penalised logistic regression with equal weight for both
    classes, by accelerated gradient steps, from ``start`` on."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    u = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest curvature, by power iteration
        u = x.T @ ((x @ u) * weight)
        top = float(np.linalg.norm(u))
        u = u / max(top, 1e-12)
    rate = np.float32(1.0 / (0.3 * top + decay))
    w = v = np.zeros(x.shape[1], np.float32) if start is None else start
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ ((p - y) * weight).astype(np.float32) + np.float32(decay) * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Model:
    """Weights and calibration (intercept, slope) of both views, and the share of good labels."""

    def __init__(self, views: list[tuple[np.ndarray, float, float]], share: float):
        self.views, self.share = views, share

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Calibrated probability of each view and of both: log-odds add up, the prior counts once."""
        if not self.views:
            p = np.full(len(x[0]), self.share)
            return p, p, p
        odds = [a + b * _logit(w, v) for (w, a, b), v in zip(self.views, x)]
        prior = math.log(self.share / (1 - self.share))
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, sum(odds) - prior))


def cotrain(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray]) -> Model:
    """Co-training of two views on labels ``y`` and an unlabelled pool.

    A quarter of the labelled rows is put aside for calibration. In each round either view labels the
    pool and hands the rows it is most certain of, in the proportion of the classes, to the
    other view's training set.
    """
    if len(y) < 8 or y.min() == y.max():
        return Model([], float(y.mean()) if len(y) else 1.0)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    aside = np.arange(len(y)) % 4 == 3
    if y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    given: list[dict[int, int]] = [{}, {}]
    weights: list[np.ndarray | None] = [None, None]
    for turn in range(ROUNDS + 1):
        for v in range(2):
            rows = np.array(sorted(given[v]), int)
            more = np.array([given[v][r] for r in rows])
            seen, said = (np.concatenate([x[v][~aside], pool[v][rows]]), np.concatenate([y[~aside], more])) if len(rows) else (x[v][~aside], y[~aside])
            weights[v] = fit_linear(seen, said, weights[v])
        if turn == ROUNDS or not len(pool[0]):
            break
        for v in range(2):
            p = 1 / (1 + np.exp(-np.clip(_logit(weights[v], pool[v]), -30, 30)))
            for label, part in ((1, share), (0, 1 - share)):
                sure = p if label else 1 - p
                best = np.argsort(-sure, kind="stable")[: max(1, int(PER_ROUND * part * len(p)))]
                given[1 - v].update({int(i): label for i in best if sure[i] >= CONFIDENT})
    use = aside if aside.any() else np.ones(len(y), bool)
    views = []
    for v in range(2):
        a, b = logistic(_logit(weights[v], x[v][use]), y[use].astype(float))
        views.append((weights[v], a, max(b, 0.0)))
    return Model(views, share)


def _views(columns: list[list]) -> list[np.ndarray]:
    texts, sources, langs = columns
    return [np.array([text_view(t) for t in texts]).reshape(-1, TEXT_DIMS), np.array([meta_view(*r) for r in zip(texts, sources, langs)]).reshape(-1, META_DIMS)]


def _features(columns: list[list]) -> list[list]:
    return [[v.astype("<f4").tobytes() for v in view] for view in _views(columns)]


def _scores(columns: list[list], model: Model) -> list[list]:
    return [list(map(float, p)) for p in model.scores(_views(columns))]


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, source_col: str, lang_col: str) -> Model:
    """Collects the features of about ``LABELLED`` + ``POOL`` documents and co-trains on them."""
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"), F.col(lang_col).alias("_l"))
    known = labelled(docs, labels, label_col, LABELLED, id_col)
    said = labels.select(F.col(id_col).alias("_id")).distinct()
    total = max(1, docs.count())
    chosen = lean.filter(F.pmod(F.xxhash64("_id", F.lit("pool")), F.lit(1_000_000)) < int(min(1.0, POOL / total) * 1_000_000)).filter(~held_out(F.col("_id")))
    pool = chosen.join(said, "_id", "left_anti").withColumn("_y", F.lit(-1))
    both = lean.join(F.broadcast(known), "_id").unionByName(pool)
    rows = map_rows(both, ["_t", "_s", "_l"], ["_id", "_y"], "a binary, b binary", _features).orderBy("_id").toLocalIterator()
    y, a, b = [], [], []
    for r in rows:
        y.append(r["_y"])
        a.append(np.frombuffer(r["a"], "<f4"))
        b.append(np.frombuffer(r["b"], "<f4"))
    labels_, views = np.array(y, int), [np.array(a).reshape(-1, TEXT_DIMS), np.array(b).reshape(-1, META_DIMS)]
    return cotrain([v[labels_ >= 0] for v in views], labels_[labels_ >= 0], [v[labels_ < 0] for v in views])


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per document: id, ``held_out`` (never learnt from), ``text_score``, ``meta_score``, ``score``
    (calibrated chance of good quality by either view and by both), ``kept`` (score of 0.5 or more).

    Null texts, sources and languages count as empty; a table without labels of both kinds gives
    every document the share of good labels (1 without labels); repeated rows are scored alike.
    """
    model = train(docs, labels, label_col, id_col, text_col, source_col, lang_col)
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"), F.col(lang_col).alias("_l"))
    out = map_rows(lean, ["_t", "_s", "_l"], ["_id"], "text_score double, meta_score double, score double", partial(_scores, model=model))
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))
