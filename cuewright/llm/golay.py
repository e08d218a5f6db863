"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 64-bit fingerprints.

Every word of 23 bits lies within 3 bits of exactly one codeword, so decoding maps it to one of 4096
indices. A word and its one-bit neighbours decode to at most six of them; two words that differ
in one bit always share an index, because one is a neighbour of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
LENGTH, RADIUS = 23, 3
BLOCKS = 6


def _remainder(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator: their syndromes of 11 bits."""
    x = x.copy()
    for i in range(LENGTH - 1, 10, -1):
        x = np.where((x >> i) & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


class Decoder:
    """Maps words of 23 bits to the index (12 bits) of their codeword, by two tables: the syndrome of
    the upper 12 bits, and the error pattern of each of the 2048 syndromes."""

    def __init__(self) -> None:
        errors = np.array([sum(1 << i for i in c) for k in range(RADIUS + 1) for c in combinations(range(LENGTH), k)], np.int64)
        self.leader = np.zeros(1 << 11, np.int64)
        self.leader[_remainder(errors)] = errors
        self.upper = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[self.upper[words >> 11] ^ (words & 2047)]) >> 11


def borders(blocks: int = BLOCKS, bits: int = 64) -> list[tuple[int, int]]:
    return [(bits * i // blocks, bits * (i + 1) // blocks) for i in range(blocks)]


def designs(blocks: int = BLOCKS) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Pairs (exact, fuzzy) of two blocks each. Whatever blocks up to three errors fall into, some pair
    has none of them in its exact blocks and at most one in its fuzzy blocks; the other two blocks
    are free. Chosen greedily: the pair that settles most of the open cases comes next."""
    every = range(blocks)
    open_cases = {tuple(sorted(c)) for c in combinations([b for b in every for _ in range(3)], 3)}
    options = []
    for exact in combinations(every, 2):
        for fuzzy in combinations([b for b in every if b not in exact], 2):
            options.append((exact, fuzzy, {c for c in open_cases if not set(c) & set(exact) and sum(b in fuzzy for b in c) <= 1}))
    out = []
    while open_cases:
        exact, fuzzy, covers = max(options, key=lambda o: len(o[2] & open_cases))
        out.append((exact, fuzzy))
        open_cases -= covers
    return out


def _cut(fps: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    out, width = np.zeros(len(fps), np.uint64), 0
    for a, b in ranges:
        out |= ((fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) << np.uint64(width)
        width += b - a
    return out, width


class Keys:
    """Keys of fingerprints: ``home`` gives one for each design, ``probes`` all within one fuzzy error."""

    def __init__(self) -> None:
        self.decode, self.plan, self.at = Decoder(), designs(), borders()

    def _parts(self, fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, int]:
        exact, fuzzy = self.plan[d]
        e, width = _cut(fps, [self.at[b] for b in exact])
        w, n = _cut(fps, [self.at[b] for b in fuzzy])
        return (np.uint64(d) << np.uint64(width + 12)) | (e << np.uint64(12)), w.astype(np.int64), n

    def home(self, fps: np.ndarray) -> np.ndarray:
        """Keys, one row per fingerprint and one column per design."""
        out = np.empty((len(fps), len(self.plan)), np.int64)
        for d in range(len(self.plan)):
            head, w, _ = self._parts(fps, d)
            out[:, d] = (head | self.decode(w).astype(np.uint64)).astype(np.int64)
        return out

    def probes(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every key under which a fingerprint within one fuzzy error may be at home."""
        rows, keys = [], []
        for d in range(len(self.plan)):
            head, w, n = self._parts(fps, d)
            near = np.sort(self.decode(np.stack([w, *[w ^ (1 << i) for i in range(n)]], axis=1)), axis=1)
            new = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
            r, c = np.nonzero(new)
            rows.append(r)
            keys.append((head[r] | near[r, c].astype(np.uint64)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(keys)
