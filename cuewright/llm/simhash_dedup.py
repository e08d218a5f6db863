"""Near-duplicates by SimHash: fuzzy Golay keys find fingerprints within three bits, links form groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, map_rows
from cuewright.llm.golay import Keys
from cuewright.operators.salting import attach

SHINGLE, SEED, BITS = 3, 42, 3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 4096


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a whole text, A-Z lower-cased, words joined by a space."""
    words = text.translate(_LOWER).split() if text else []  # splits at space, tab, LF, VT, FF, CR
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, highest bit first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half the hashes have it; zero without hashes; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = (2 * bit_sums(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def _fingerprints(columns: list[list]) -> list[list]:
    return [[fingerprint(shingle_hashes(t)) for t in columns[0]]]


def _emit(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), _BLOCK):
                part = fps[at : at + _BLOCK]
                if kind == "home":
                    k = keys.home(part.view(np.uint64))
                    rows, k = np.repeat(np.arange(len(part)), k.shape[1]), k.ravel()
                else:
                    rows, k = keys.probes(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[rows])], ["key", kind])

    return run


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of the given distinct fingerprints (column ``fp``) at three or fewer
    differing bits, each once.

    Every fingerprint is at home under one Golay key for each design and probes the few keys of its
    one-bit neighbourhood; ``golay.designs`` guarantees that one design separates any three errors,
    so no link is missed. Candidates meet in a plain equi-join, whose crowded keys adaptive
    execution splits, and are verified inside it.
    """
    home = fps.select("fp").mapInArrow(_emit("home"), "key bigint, home bigint")
    probe = fps.select("fp").mapInArrow(_emit("probe"), "key bigint, probe bigint")
    near = F.bit_count(F.col("home").bitwiseXOR(F.col("probe"))) <= BITS
    met = home.alias("h").join(probe.alias("p"), (F.col("h.key") == F.col("p.key")) & (F.col("home") < F.col("probe")) & near)
    return met.select(F.col("home").alias("a"), F.col("probe").alias("b")).distinct()


def components(pairs: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for the nodes of the pairs ``a`` < ``b`` but the roots.

    Alternates large-star and small-star steps, which link every node to smaller ones until each
    component is a star; the number of rounds grows with the logarithm of its size. Each round is
    written to the checkpoint folder by ``cut``. Copies of the one-row-per-node minimum share a crowded node.
    """
    state = cut(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    mark = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        large = attach(both, least, ["u"], "inner", salts=8).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = attach(large, least, ["u"], "inner", salts=8)
        small = small.select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.greatest("v", "_m").alias("u"), F.least("v", "_m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = cut(small.filter("u != v").distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _groups(prints: DataFrame) -> DataFrame:
    """``fp``, ``root``, ``component_id`` for the rows (``_id``, ``fp``) of a written table."""
    per = cut_lineage(prints.groupBy("fp").agg(F.min("_id").alias("_least")))
    roots = components(links(per.select("fp")))
    per = per.join(roots, per["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    ids = per.groupBy("root").agg(F.min("_least").alias("component_id"))
    return per.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id of its group).

    Null and empty texts have the fingerprint zero and are linked like any other; repeated rows and
    exact copies share one fingerprint and are never paired; null ids count only where a group has
    no other; an empty table gives no rows.
    """
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    prints = cut_lineage(map_rows(lean, ["_t"], ["_id"], "fp bigint", _fingerprints))
    groups = cut_lineage(_groups(prints))
    return prints.join(groups, "fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id (one of its rows, if the id repeats), with the
    columns of ``docs``."""
    lean = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    groups = cut_lineage(_groups(cut_lineage(map_rows(lean, ["_t"], ["_id"], "fp bigint", _fingerprints))))
    full = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    full = map_rows(full, ["_t"], ["_doc", "_id"], "fp bigint", _fingerprints).join(groups, "fp")
    return full.filter(F.col("_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"]).select("_doc.*")
