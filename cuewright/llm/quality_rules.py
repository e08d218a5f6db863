"""Quality rules per document, and the hosts that break them too often."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage, map_rows

#: Fixed by the contract: words, symbols, fewest words, repeated share in percent, window.
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5

FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

#: The method's own rules: symbols per word, duplicate lines per word, mean length of a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 0.1, 0.05, (2.0, 20.0)
#: Hosts: below ``TRUSTED`` a host's rate excuses a document's own soft failures, at ``REJECTED`` the
#: host goes as a whole. A host whose rate is ``SURE`` standard errors off that of all hosts has its documents
#: held to soft limits that are ``FACTOR`` times wider (lower rate) or narrower (higher rate).
TRUSTED, REJECTED, SURE, FACTOR = 0.01, 0.6, 2.0, 2.0
#: Verdicts of up to so many hosts are sent to all executors; those of more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one whole text; a null text has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    n = len(words)
    dup = 0
    if "\n" in text:
        lines = Counter(text.split("\n"))
        dup = sum(c - 1 for line, c in lines.items() if c > 1 and _WORDS.search(line))
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)]))
        if len(seen := set(windows)) < len(windows):
            more = {w for w, c in Counter(windows).items() if c > 1}
            end = 0
            for i, w in enumerate(windows):
                if w in more:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
        del seen
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated


def _counts(columns: list[list]) -> list[list]:
    return [list(c) for c in zip(*map(text_counts, columns[0]))] if columns[0] else [[]] * 5


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def soft_failed(width: Column | float = 1.0) -> Column:
    """Whether a document breaks one of the method's own rules, whose limits are ``width`` times as wide."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    mean, width = F.col("word_chars") / n, width if isinstance(width, Column) else F.lit(width)
    return (F.col("n_symbols") / n > width * MAX_SYMBOLS) | (F.col("n_dup_lines") / n > width * MAX_DUP_LINES) | ~mean.between(WORD_LENGTH[0] / width, WORD_LENGTH[1] * width)


def host_verdicts(features: DataFrame) -> DataFrame:
    """Per host: rows ``n``, failures ``f`` (a base or a soft rule), shrunk ``rate``, ``verdict``.

    The beta prior is fitted to all hosts by moments: its mean is the mean of the hosts' rates, its
    strength follows from their variance beyond what binomial counts explain (no such variance:
    a strong prior, all hosts near the mean). rate = (f + a) / (n + a + b), so a host of few
    documents stays near the mean. Verdicts: ``trusted``, ``lenient``, ``mixed``, ``strict``, ``rejected``; the second
    and fourth where the posterior leaves little doubt that the rate is under or over the mean.
    """
    per = features.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(base_failed() | soft_failed(), 1).otherwise(0)).alias("f"))
    p = F.col("f") / F.col("n")
    prior = per.agg(F.avg(p).alias("_m"), F.coalesce(F.var_pop(p), F.lit(0.0)).alias("_v"), F.avg(1 / F.col("n")).alias("_inv"))
    spread = F.col("_m") * (1 - F.col("_m"))
    beyond = (F.col("_v") - spread * F.col("_inv")) / F.greatest(1 - F.col("_inv"), F.lit(1e-9))
    strength = F.when(beyond > 0, F.greatest(F.least(spread / beyond - 1, F.lit(1e4)), F.lit(1.0))).otherwise(F.lit(1e4))
    prior = prior.select("_m", strength.alias("_s"))
    per = per.crossJoin(F.broadcast(prior))  # one row
    rate = (F.col("f") + F.col("_m") * F.col("_s")) / (F.col("n") + F.col("_s"))
    off = (F.col("rate") - F.col("_m")) / F.sqrt(F.greatest(F.col("rate") * (1 - F.col("rate")), F.lit(1e-12)) / (F.col("n") + F.col("_s") + 1))
    verdict = F.when(F.col("rate") >= REJECTED, F.lit("rejected")).when(F.col("rate") < TRUSTED, F.lit("trusted"))
    verdict = verdict.when(off > SURE, F.lit("strict")).when(off < -SURE, F.lit("lenient")).otherwise(F.lit("mixed"))
    return per.withColumn("rate", rate).withColumn("verdict", verdict).select("host", "n", "f", "rate", "verdict")


def _decided(features: DataFrame, hosts: DataFrame) -> DataFrame:
    """Joins host verdicts back. A document that breaks a base rule goes; one of a rejected host goes;
    one that breaks a soft rule, as wide as its host's verdict makes it, goes unless the host is trusted."""
    other = hosts.select(F.col("host").alias("_h"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    if hosts.count() <= BROADCAST_HOSTS:  # ``hosts`` is a written table of one short row per host
        other = F.broadcast(other)
    joined = features.join(other, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    width = F.when(F.col("host_verdict") == "strict", 1 / FACTOR).when(F.col("host_verdict") == "lenient", FACTOR).otherwise(1.0)
    ok = (F.col("host_verdict") != "rejected") & (~soft_failed(width) | (F.col("host_verdict") == "trusted"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ok)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: id, ``host``, the five counts, ``base_failed``, ``host_rate``, ``host_verdict``, ``kept``.

    Null and empty texts have no words and fail; documents without a host form one host; repeated
    rows are judged alike; an empty table gives no rows.
    """
    lean = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_t"))
    features = cut_lineage(map_rows(lean, ["_t"], ["_id", "host"], FEATURES, _counts))
    return _decided(features, cut_lineage(host_verdicts(features))).withColumnRenamed("_id", id_col)


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The texts are counted twice (for the
    hosts, then for the rows) rather than written in between."""
    lean = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("_t"))
    hosts = cut_lineage(host_verdicts(map_rows(lean, ["_t"], ["host"], FEATURES, _counts)))
    full = docs.select(F.struct("*").alias("_doc"), F.col(host_col).alias("host"), F.col(text_col).alias("_t"))
    rows = _decided(map_rows(full, ["_t"], ["_doc", "host"], FEATURES, _counts), hosts)
    return rows.filter("kept").select("_doc.*")
