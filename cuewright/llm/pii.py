"""Personal data: exact patterns, widened by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import map_rows, sample_rows

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on at most, their longest text, and the hashed feature space.
TRAIN_DOCS, TRAIN_CHARS, DIMS = 1000, 50_000, 4096
#: Posterior probability that a token's label must reach.
CERTAIN = 0.95
#: A document's messages are settled when none moves by more than this in a round. The step of a round is halved
#: for ``STEADY`` rounds, then shrinks by ``SHRINK``; when it is under ``SETTLED`` too, messages that swing end.
SETTLED, STEADY, SHRINK = 1e-4, 64, 0.97

# Fixed by the contract: the base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever it begins, so no text takes more than one pass
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping per kind, in the order of ``KINDS``.

    Equal to running each pattern over the text, but linear: an address is found from its @ sign
    (the part in front of it holds none, so it is the run of local characters up to there, behind the
    last address), and a dotted number gives its parts in fours.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = m.group().split(".")
        pos = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = pos + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", pos, stop))
            pos = stop + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))


# --- tokens and their graph -------------------------------------------------------------------

_MARK = re.compile("[0-9@]")
_BLANKS = " \t\n\x0b\x0c\r"
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_RUN = re.compile(r"(.)\1+")
_EDGE = ".,;:!?\"'<>[]{}|#*$%&"


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an @ sign. Only these can carry one of the four kinds; all other
    words are outside by definition, and the chain is cut at them."""
    out, end = [], 0
    m = _MARK.search(text)
    while m:
        start = max(text.rfind(c, end, m.start()) for c in _BLANKS) + 1 or end
        stop = _BLANK.search(text, m.end())
        stop = stop.start() if stop else len(text)
        out.append((max(start, end), stop))
        end = stop
        m = _MARK.search(text, end)
    return out


def _shape(word: str) -> str:
    s = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in word)
    return _RUN.sub(lambda m: m[1] + (str(min(len(m[0]), 9)) if m[1] == "9" else "+"), s)


def _around(text: str, start: int, stop: int) -> tuple[str, str]:
    before, after = text[max(0, start - 40) : start].split(), text[stop : stop + 40].split()
    return (before[-1] if before else ""), (after[0] if after else "")


def features(text: str, start: int, stop: int) -> list[int]:
    """Hashed indicator features: shape of the token and its neighbours, digits, marks, context words."""
    word = text[start:stop]
    core = word.strip(_EDGE)
    left, right = _around(text, start, stop)
    digits = sum(map(str.isdigit, word))
    here, before, after = _shape(core), _shape(left.strip(_EDGE)), _shape(right.strip(_EDGE))
    names = (
        "1", "s" + here, "d" + str(min(digits, 20)), "@" + str(word.count("@")), "." + str(min(core.count("."), 5)),
        "e" + core[:1] + core[-1:] if not core[:1].isalnum() else "e", "k" + ("n" if digits == len(core) else "m"),
        "l" + before, "r" + after, "w" + left.lower()[-8:], "v" + right.lower()[:8],
        "p" + before + "/" + here, "q" + here + "/" + after,
    )
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) % DIMS for x in names]


N_FEATURES = 13


def keys_of(word: str) -> list[str]:
    """Keys under which repeated or similar tokens meet: the bare token, its last seven digits, its
    address or the two halves of one."""
    core = word.strip(_EDGE + "()").lower()
    out = ["t" + core]
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) >= 7:
        out.append("d" + digits[-7:])
    local, _, domain = core.partition("@")
    if local and domain:
        out.append("l" + local)
    return out


class Graph:
    """Tokens of many documents as one graph: ``feats``, chain edges (neighbours parted by blanks
    only) and skip edges. Every key that a document holds twice or more is a hub node behind the
    tokens (number ``len(spans)`` on), and each of its tokens has one skip edge to it, so evidence is
    two steps from all repeats however many there are. ``hub_doc`` names the document of each hub."""

    def __init__(self, texts: list[str]):
        self.doc, self.spans, feats, chain, groups = [], [], [], [], []
        self.hub_doc: list[int] = []
        for d, text in enumerate(texts):
            seen: dict[str, list[int]] = {}
            last = None
            for start, stop in tokens_of(text):
                me = len(self.spans)
                self.doc.append(d)
                self.spans.append((start, stop))
                feats.append(features(text, start, stop))
                if last is not None and not text[last[1] : start].strip(_BLANKS):
                    chain.append((last[0], me))
                for k in keys_of(text[start:stop]):
                    seen.setdefault(k, []).append(me)
                last = (me, stop)
            shared = dict.fromkeys(tuple(g) for g in seen.values() if len(g) > 1)  # keys of the same tokens are one
            groups += shared
            self.hub_doc += [d] * len(shared)
        n = len(self.spans)
        self.feats = np.array(feats, np.int64).reshape(-1, N_FEATURES)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array([(n + h, i) for h, g in enumerate(groups) for i in g], np.int64).reshape(-1, 2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Field:
    """Skip-chain CRF: node weights (features x labels), chain and skip potentials (labels x labels)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @staticmethod
    def fit(graph: Graph, labels: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Maximises the pseudo-likelihood (each label given its neighbours' labels) by AdaGrad."""
        n, k = len(labels), len(KINDS) + 1
        node, chain, skip = np.zeros((DIMS, k)), np.zeros((k, k)), np.eye(k)
        if not n:
            node[:, 0] = 1.0
            return Field(node, chain, skip)
        truth = np.eye(k)[labels]
        # A hub shows each of its tokens the most frequent label of the others.
        hub, spoke = graph.skip[:, 0] - n, graph.skip[:, 1]
        counts = np.zeros((len(graph.hub_doc), k))
        np.add.at(counts, hub, truth[spoke])
        shown = (counts[hub] - truth[spoke]).argmax(1) if len(hub) else np.zeros(0, np.int64)
        squares = [np.full_like(x, 1e-6) for x in (node, chain, skip)]
        for _ in range(steps):
            score = node[graph.feats].sum(1)
            if len(graph.chain):
                np.add.at(score, graph.chain[:, 1], chain[labels[graph.chain[:, 0]]])
                np.add.at(score, graph.chain[:, 0], chain.T[labels[graph.chain[:, 1]]])
            np.add.at(score, spoke, skip[shown])
            miss = (truth - _softmax(score)) / n
            g_node = np.zeros_like(node)
            np.add.at(g_node, graph.feats, miss[:, None, :])
            grads = [g_node - decay * node / n]
            g_chain, g_skip = np.zeros_like(chain), np.zeros_like(skip)
            np.add.at(g_chain, labels[graph.chain[:, 0]], miss[graph.chain[:, 1]])
            np.add.at(g_chain.T, labels[graph.chain[:, 1]], miss[graph.chain[:, 0]])
            np.add.at(g_skip, shown, miss[spoke])
            grads += [g_chain - decay * chain / n, g_skip - decay * skip / n]
            for x, g, s in zip((node, chain, skip), grads, squares):
                s += g * g
                x += rate * g / np.sqrt(s)
        return Field(node, chain, skip)

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy belief propagation: damped sum-product messages along all edges at once, each
        document until its own messages are settled, so that texts do not depend on their batch.
        Hubs have no evidence of their own. Gives the tokens' label probabilities."""
        n = len(graph.spans)
        unary = np.concatenate([self.node[graph.feats].sum(1), np.zeros((len(graph.hub_doc), len(KINDS) + 1))])
        edges = np.concatenate([graph.chain, graph.skip])
        if not len(edges):
            return _softmax(unary[:n])
        kind = np.repeat([0, 1], [len(graph.chain), len(graph.skip)])
        pair = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
        m = len(edges)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        form = np.concatenate([kind, kind + 2])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        home = np.concatenate([graph.doc, graph.hub_doc]).astype(np.int64)[src]
        msg = np.zeros((2 * m, unary.shape[1]))
        live, step, rounds = np.arange(2 * m), 0.5, 0
        while len(live):
            belief = unary.copy()
            np.add.at(belief, dst[live], msg[live])
            out = (belief[src[live]] - msg[back[live]])[:, :, None] + pair[form[live]]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            move = np.abs(new - msg[live]).max(1)
            msg[live] += step * (new - msg[live])
            docs, at = np.unique(home[live], return_inverse=True)
            moved = np.zeros(len(docs))
            np.maximum.at(moved, at, move)
            rounds += 1
            if rounds > STEADY:
                step *= SHRINK
            going = docs[moved > SETTLED] if step > SETTLED else docs[:0]
            live = live[np.isin(home[live], going)]
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief[:n])


# --- fitting ------------------------------------------------------------------------------------


def _disguised(text: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A text whose base spans are partly written in ways that the patterns miss, with all spans."""
    out, spans, at = [], [], 0
    size = 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a < at:
            continue
        value = text[a:b]
        if rng.random() < 0.5:
            digits = _NOT_DIGIT.sub("", value)
            if kind == "phone":
                value = rng.choice([re.sub(r"^\+[0-9]+[ .-]?", "", value) or value, "00" + digits, digits[-10:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"])
            elif kind == "card":
                value = rng.choice([".", "/", "-", " "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
            elif kind == "email":
                value = rng.choice([value.replace("@", "@@"), value.split("@")[0] + "@localhost", "<" + value + ">"])
            else:
                value = rng.choice([value + ":8080", value + "/24", value])
        out += [text[at:a], value]
        size += a - at
        spans.append((kind, size, size + len(value)))
        size += len(value)
        at = b
    return "".join([*out, text[at:]]), spans


def fit_field(texts: list[str], seed: int = 7) -> Field:
    """Fits the field to the sample as it is and once more with half of its spans disguised."""
    rng = random.Random(seed)
    rows = [(t, base_spans(t)) for t in texts] + [_disguised(t, rng) for t in texts]
    graph = Graph([t for t, _ in rows])
    labels = np.zeros(len(graph.spans), np.int64)
    for i, (d, (a, b)) in enumerate(zip(graph.doc, graph.spans)):
        for kind, x, y in rows[d][1]:
            if a < y and x < b:
                labels[i] = KINDS.index(kind) + 1
                break
    return Field.fit(graph, labels)


def _plausible(kind: str, value: str) -> bool:
    digits = sum(c in "0123456789" for c in value)
    other = sum(c.isalpha() for c in value)
    if kind == "email":
        return "@" in value and value.index("@") > 0
    if kind == "ip":
        return value.count(".") >= 3 and digits >= 4
    return not other and (13 <= digits <= 19 if kind == "card" else 7 <= digits <= 15)


def added_spans(text: str, spans: list[tuple[int, int]], best: np.ndarray, sure: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of neighbouring tokens of one certain label that touch no base span; a span must
    look like its kind (an @ sign, four numbers, a number of digits)."""
    out: list[Span] = []
    run: list[int] = []
    covered = sorted((a, b) for _, a, b in base)

    def close() -> None:
        if not run:
            return
        a, b = spans[run[0]][0], spans[run[-1]][1]
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        kind = KINDS[best[run[0]] - 1]
        if a < b and _plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in covered):
            out.append((kind, a, b))
        run.clear()

    for i, (a, b) in enumerate(spans):
        ok = best[i] > 0 and sure[i] >= CERTAIN and not any(x < b and a < y for x, y in covered)
        joins = run and ok and best[i] == best[run[-1]] and best[i] >= 3 and not text[spans[run[-1]][1] : a].strip(" ")
        if not joins:
            close()
        if ok:
            run.append(i)
    close()
    return out


SCHEMA = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def _scan(columns: list[list], field: Field) -> list[list]:
    texts = [t or "" for t in columns[0]]
    graph = Graph(texts)
    p = field.marginals(graph) if len(graph.spans) else np.zeros((0, len(KINDS) + 1))
    best, sure = p.argmax(1), p.max(1)
    first = np.searchsorted(graph.doc, np.arange(len(texts) + 1)) if graph.doc else np.zeros(len(texts) + 1, int)
    rows = []
    for d, text in enumerate(texts):
        base = base_spans(text) if first[d] < first[d + 1] else []
        lo, hi = first[d], first[d + 1]
        more = added_spans(text, graph.spans[lo:hi], best[lo:hi], sure[lo:hi], base) if (best[lo:hi] > 0).any() else []
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        rows.append([*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)])
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``,
    ``spans`` (base and added, kind:start:end in code points), ``n_added``.

    The field is fitted on about ``train_docs`` whole documents of up to ``TRAIN_CHARS`` characters
    that hold a digit or an @ sign, chosen by hash, with the base spans as labels; then it labels
    every token of every document.
    Null and empty texts have no spans; repeated rows are treated alike; an empty table gives none.
    """
    marked = docs.select(F.col(text_col).alias("_t"), F.col(id_col).alias("_id")).filter((F.length("_t") <= TRAIN_CHARS) & F.col("_t").rlike("[0-9@]"))
    sample = sample_rows(marked, ["_id", "_t"], train_docs).select("_t")
    field = fit_field(sorted(r[0] for r in sample.toLocalIterator()))
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return map_rows(lean, ["_t"], ["_id"], SCHEMA, partial(_scan, field=field)).withColumnRenamed("_id", id_col)
