"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, map_rows

#: Labelled documents that are learnt from at most (about; chosen by a hash of the id).
TRAIN_ROWS = 200_000
#: Of these, documents that the three numbers of the calibration (scale, intercept, slope) are fitted to at most (about).
CALIBRATION_ROWS = 20_000
#: What each token costs besides its log-odds.
BACKGROUND = -0.3
#: A prefix stands for the words that begin with it, so that rare inflections count.
PREFIXES = (4, 5, 6)
#: Fixed by the contract: score from which a document is predicted toxic.
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Fixed by the contract: the quarter of ids that is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Ids and labels (``_id``, ``_y``) that may be learnt from: not held out, about ``rows`` at most."""
    per = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    per = per.filter(~held_out(F.col("_id")))
    share = min(1.0, rows / max(1, per.count()))
    return per if share == 1.0 else per.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def token_counts(texts: DataFrame) -> DataFrame:
    """``word``, number ``yt`` of toxic and ``yn`` of other texts that hold it, of (``_t``, ``_y``);
    repeats within a text count once, so that a text that drones on has no more say than another."""
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("_t"), r"[^\p{L}]+"))).alias("word"), "_y").filter("word != ''")
    return words.groupBy("word").agg(F.sum(F.col("_y").cast("long")).alias("yt"), F.sum((1 - F.col("_y")).cast("long")).alias("yn"))


#: Strengths (pseudo-counts) of the Dirichlet priors that are mixed, from words that tell much to words that tell nothing.
STRENGTHS = 2.0 ** np.arange(-1, 13, 2)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, eight steps up."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(np.prod([x + i for i in range(8)], axis=0))


def _likelihoods(yt: np.ndarray, yn: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood (beta-binomial, less what all strengths share) of counts under each of ``STRENGTHS``, in the last axis."""
    a, b = STRENGTHS * share, STRENGTHS * (1 - share)
    yt, yn = yt[..., None], yn[..., None]
    return _lgamma(yt + a) + _lgamma(yn + b) - _lgamma(yt + yn + a + b) - (_lgamma(a) + _lgamma(b) - _lgamma(a + b))


def fit_prior(yt: np.ndarray, yn: np.ndarray, times: np.ndarray, share: float, rounds: int = 300) -> np.ndarray:
    """Weights of ``STRENGTHS`` by empirical Bayes: EM on the marginal likelihood of the words' counts, each pair
    (``yt``, ``yn``) seen ``times``."""
    like = _likelihoods(yt, yn, share)
    like = np.exp(like - like.max(-1, keepdims=True))
    w = np.full(len(STRENGTHS), 1 / len(STRENGTHS))
    for _ in range(rounds):
        part = like * w
        w = (part / part.sum(-1, keepdims=True) * times[:, None]).sum(0) / times.sum()
    return w


def shrunk(yt: np.ndarray, yn: np.ndarray, share: float, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and standard error of the log-odds of toxic against other text. A prior's pseudo-counts are
    split as all text is, so that no evidence means log-odds of 0; strengths count by how well they explain the counts."""
    like = _likelihoods(yt, yn, share)
    part = np.exp(like - like.max(-1, keepdims=True)) * prior
    part /= part.sum(-1, keepdims=True)
    at, an = yt[..., None] + STRENGTHS * share, yn[..., None] + STRENGTHS * (1 - share)
    each = np.log(at / an) - math.log(share / (1 - share))
    mean = (part * each).sum(-1)
    return mean, np.sqrt((part * (1 / at + 1 / an + (each - mean[..., None]) ** 2)).sum(-1))


def feature_counts(counts: DataFrame) -> DataFrame:
    """``feature``, ``yt``, ``yn`` of words (``=word``) and prefixes (``prefix*``)."""
    parts = [F.array(F.concat(F.lit("="), "word"))]
    for k in PREFIXES:
        parts.append(F.when(F.length("word") >= k, F.array(F.concat(F.substring("word", 1, k), F.lit("*")))).otherwise(F.array().cast("array<string>")))
    return counts.select(F.explode(F.concat(*parts)).alias("feature"), "yt", "yn").groupBy("feature").agg(F.sum("yt").alias("yt"), F.sum("yn").alias("yn"))


class Lexicon:
    """Scores of words: that of the feature with the z furthest from 0, else the background score.

    Features are kept as sorted XXH64 hashes beside their counts (16 bytes each), as every one counts. Counts
    instead of scores let a labelled text be scored as if it had not been learnt from. Few pairs of counts differ, so
    what they say is worked out once for each.
    """

    def __init__(self, hashes: np.ndarray, yt: np.ndarray, yn: np.ndarray, share: float = 0.5, prior: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.rows = hashes[order], yt[order].astype(np.int32), yn[order].astype(np.int32), share, prior
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, float] = {}
        self.places: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[float, float]] = {}

    def __getstate__(self):
        return self.rows

    def __setstate__(self, rows):
        self.rows = rows
        self._forget()

    def __len__(self) -> int:
        return len(self.rows[0])

    def _places(self, words: list[str]) -> np.ndarray:
        """Row of the word and of each of its prefixes, -1 where there is none."""
        out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
        hashes = self.rows[0]
        for j, k in enumerate((0, *PREFIXES)):
            of = np.array([i for i, w in enumerate(words) if len(w) >= k], np.int64)
            names = (("=" + words[i] if k == 0 else words[i][:k] + "*").encode() for i in of.tolist())
            h = np.fromiter((xxhash.xxh64_intdigest(f, 42) for f in names), np.uint64, len(of)).view(np.int64)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out[of, j] = np.where(hashes[at] == h, at, -1)
        return out

    def _evidence(self, yt: np.ndarray, yn: np.ndarray) -> np.ndarray:
        """Log-odds and size of z of pairs of counts (last axis)."""
        keys, inverse = np.unique((yt.astype(np.int64) << 32) | yn.astype(np.int64), return_inverse=True)
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        new = [k for k in keys.tolist() if k not in self.pairs]
        if new:
            both = np.array(new, np.int64)
            delta, error = shrunk((both >> 32).astype(float), (both & 0xFFFFFFFF).astype(float), *self.rows[3:])
            self.pairs.update(zip(new, zip(delta.tolist(), (np.abs(delta) / error).tolist())))
        return np.array([self.pairs[k] for k in keys.tolist()])[inverse.ravel()].reshape(*yt.shape, 2)

    def _said(self, at: np.ndarray, less: tuple[np.ndarray | int, np.ndarray | int] = (0, 0)) -> np.ndarray:
        _, yt, yn, *_ = self.rows
        found = self._evidence(np.maximum(yt[at] - less[0], 0), np.maximum(yn[at] - less[1], 0))
        delta, z = found[..., 0], np.where(at >= 0, found[..., 1], -1.0)
        pick = z.argmax(1)[:, None]
        return np.where(np.take_along_axis(at, pick, 1) >= 0, np.take_along_axis(delta, pick, 1) + BACKGROUND, BACKGROUND)[:, 0]

    def learn(self, words: set[str]) -> dict[str, float]:
        """Scores by word of ``words`` at least; those met before are remembered."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        if new:
            self.seen.update(zip(new, self._said(self._places(new)).tolist()) if len(self) else dict.fromkeys(new, BACKGROUND))
        return self.seen

    def without(self, words: set[str], label: int) -> dict[str, float]:
        """Scores by word of a text with this label, the text's own words taken out of the counts."""
        if not words or not len(self):
            return dict.fromkeys(words, BACKGROUND)
        if len(self.places) > 200_000:
            self.places.clear()
        new = [w for w in words if w not in self.places]
        if new:
            self.places.update(zip(new, map(tuple, self._places(new).tolist())))
        names = list(words)
        at = np.array([self.places[w] for w in names], np.int64)
        _, inverse, own = np.unique(at, return_inverse=True, return_counts=True)
        own = own[inverse].reshape(at.shape)
        return dict(zip(names, self._said(at, (own, 0) if label == 1 else (0, own)).tolist()))


def segments(scores: list[tuple[int, float]], background: float = BACKGROUND, before: list[float] | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) in linear time.

    ``scores`` holds the positive tokens by position, ``before`` the running total in front of each of
    them; without it every other token costs ``background``. Each
    positive token starts as a segment; it is joined with the nearest earlier one that starts lower, as
    long as that one also ends lower (in running totals), so the kept segments are those no extension
    or cut improves.
    """
    out: list[list] = []  # first, end, total before, total after, nearest earlier segment that starts lower
    total, last = 0.0, 0
    for i, (at, s) in enumerate(scores):
        total = before[i] if before is not None else total + background * (at - last)
        new = [at, at + 1, total, total + s, -1]
        total += s
        last = at + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            back = out[j][4]
            del out[j:]
            j = back
    return [(a, b, after - before) for a, b, before, after, _ in out]


def _scan(columns: list[list], lexicon: Lexicon) -> list[list]:
    """Number of words and segments of each text; with a second column of labels, as if not learnt from."""
    n_words, found = [], []
    for i, text in enumerate(columns[0]):
        words = _WORDS.findall(text.lower()) if text else []
        known = lexicon.learn(set(words)) if len(columns) == 1 else lexicon.without(set(words), columns[1][i])
        scores = np.fromiter((known[w] for w in words), float, len(words))
        hits = np.flatnonzero(scores > 0)
        before = (np.cumsum(scores) - scores)[hits]
        n_words.append(len(words))
        found.append([{"first": a, "until": b, "score": s} for a, b, s in segments(list(zip(hits.tolist(), scores[hits].tolist())), before=before.tolist())])
    return [n_words, found]


def decay(bins: list[tuple[float, float]]) -> float:
    """The positive root of sum p * exp(x * score) = 1 over (score, clean frequency): the rate at which
    the chance of a clean segment falls with its score."""
    if not bins or sum(p * s for s, p in bins) >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    value = lambda x: sum(p * np.exp(min(x * s, 700)) for s, p in bins) - 1
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a lightly penalised logistic regression, by Newton steps."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """Per document: id, ``held_out``, ``score`` (chance of the toxic label), ``predicted``, ``passages``
    (first word, end, score of every significant segment), ``best_p`` (p-value of the best one).

    Words are counted in labelled documents that are not held out; the log-odds of all of them, toxic or not,
    form the lexicon. Their prior is fitted to the same counts (``fit_prior``). Segment maxima of clean
    training documents follow a Gumbel law with the decay rate of the clean score distribution; its scale is
    fitted by maximum likelihood. A segment's evidence is its score in units of that law beyond what a document
    of that length reaches by chance; a document's evidence, summed over its segments, is turned into a
    probability by a logistic curve. Scale and curve are fitted to training documents (about ``calibration_rows``) that are scored with
    their own words taken out of the counts (one left out), as they would otherwise look surer than new ones.
    Null and empty texts have no evidence; without labels of both kinds every document gets the share
    of toxic labels; an empty table gives no rows; repeated rows are scored alike.
    """
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    known = cut_lineage(labelled(docs, labels, label_col, train_rows, id_col))
    # ``known`` has about ``train_rows`` rows at most, so its size is bounded and no text is shuffled for it
    counts = cut_lineage(token_counts(lean.join(F.broadcast(known), "_id")))
    nt, nn = (int(v or 0) for v in counts.agg(F.sum("yt"), F.sum("yn")).first())
    lexicon, rate = Lexicon(np.empty(0, np.int64), np.empty(0), np.empty(0)), 1.0
    if nt and nn:
        share = nt / (nt + nn)
        pairs = counts.groupBy("yt", "yn").agg(F.count(F.lit(1)).alias("times")).toArrow()  # distinct counts: far fewer than words
        prior = fit_prior(*(pairs[c].to_numpy().astype(float) for c in ("yt", "yn", "times")), share)
        # bounded by the words of the training rows, 16 bytes for each word or prefix
        rows = feature_counts(counts).select(F.xxhash64("feature").alias("h"), F.col("yt").cast("int"), F.col("yn").cast("int")).toArrow()
        lexicon = Lexicon(*(rows[c].to_numpy() for c in ("h", "yt", "yn")), share, prior)
    if len(lexicon):
        per_word = map_rows(counts, ["word"], ["yn"], "s double", partial(_word_scores, lexicon=lexicon))
        bins = per_word.groupBy("s").agg(F.sum("yn").alias("n")).collect()  # scores rounded to tenths
        whole = sum(r["n"] for r in bins) + 0.5 * len(bins)
        rate = decay([(r["s"], (r["n"] + 0.5) / whole) for r in bins])
    schema = "n_words bigint, segments array<struct<first:bigint,until:bigint,score:double>>"
    found = map_rows(lean, ["_t"], ["_id"], schema, partial(_scan, lexicon=lexicon))
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    part = min(1.0, calibration_rows / max(1, known.count()))
    judged = known if part == 1.0 else known.filter(F.pmod(F.xxhash64("_id", F.lit("calibration")), F.lit(1_000_000)) < int(part * 1_000_000))
    train = lean.join(F.broadcast(judged), "_id").select("_t", "_y")
    train = cut_lineage(map_rows(train, ["_t", "_y"], ["_y"], schema, partial(_scan, lexicon=lexicon)).withColumn("_best", best))
    clean = train.filter("_y = 0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_words") * F.exp(-rate * F.col("_best"))).alias("m")).first()
    scale = clean["n"] / clean["m"] if clean["m"] else 1.0
    chance = F.log(F.greatest(F.col("n_words"), F.lit(1)) * F.lit(scale))
    evidence = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(s["score"] * rate - chance, F.lit(0.0)))
    # (evidence, label) pairs: at most about ``calibration_rows`` of them
    pairs = np.array([tuple(r) for r in train.select(F.log1p(evidence), F.col("_y").cast("double")).toLocalIterator()]).reshape(-1, 2)
    share = float(pairs[:, 1].mean()) if len(pairs) else 0.0
    if len(lexicon) and 0 < share < 1:
        a, b = logistic(pairs[:, 0], pairs[:, 1])
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 0.0)) * F.log1p(evidence))))
    else:
        score = F.lit(share)
    significant = F.filter("segments", lambda s: s["score"] * rate - chance > 0)
    return found.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        F.round(score, 9).alias("score"),
        (F.round(score, 9) >= THRESHOLD).cast("int").alias("predicted"),
        significant.alias("passages"),
        (1 - F.exp(-F.exp(chance - rate * best))).alias("best_p"),
    )


def _word_scores(columns: list[list], lexicon: Lexicon) -> list[list]:
    known = lexicon.learn(set(columns[0]))
    return [[round(known[w], 1) for w in columns[0]]]
