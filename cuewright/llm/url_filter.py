"""URL filter: rules first, then the ratio of two character models of variable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import cut_lineage
from cuewright.operators.salting import attach

#: Fixed by the contract: (verdict, rule). A rule is a host and the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Characters of context at most, and the share of ruled URLs (in sixteenths) kept for calibration.
ORDER, HELD_OUT = 5, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits (its host or a subdomain, a path that starts with its path), else null."""
    found = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found


def _verdict_of(rule: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)) if out is None else out.when(rule == text, F.lit(verdict))
    return out


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """A row per character (and one for the end): ``gram``, the character after its ``order`` predecessors."""
    padded = F.concat(F.lit("\x02" * order), "_s", F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length("_s") + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))
    return urls.withColumn("gram", F.explode(grams))


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``delta``: log p_allow - log p_block of a gram's last character given the rest.

    ``counts`` has each gram with its occurrences ``a`` and ``r`` in allowed and blocked URLs. Both
    models interpolate all orders after Witten and Bell: a context seen n times with t different
    successors gives (count + t * shorter) / (n + t); an unseen context falls back to the shorter
    one; below order 0 each of 256 characters is as likely.
    """
    subs = counts.select("gram", "a", "r", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")).withColumn("sub", F.expr("right(gram, k + 1)"))
    level = subs.groupBy("k", "sub").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    context = F.expr("left(sub, k)")
    sums = level.groupBy("k", context.alias("ctx")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count(F.when(F.col("a") > 0, 1)).alias("ta"), F.count(F.when(F.col("r") > 0, 1)).alias("tr"))
    level = level.withColumn("ctx", context).join(sums, ["k", "ctx"]).drop("ctx")
    steps = attach(subs.select("gram", "k", "sub"), level, ["k", "sub"], "inner", salts=8)
    steps = steps.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "a", "na", "ta", "r", "nr", "tr"))).alias("_steps"))

    def prob(c: str, n: str, t: str) -> Column:
        def step(p: Column, x: Column) -> Column:
            whole = (x[n] + x[t]).cast("double")
            return F.when(whole > 0, (x[c] + x[t] * p) / whole).otherwise(p)

        return F.aggregate("_steps", F.lit(1 / 256), step)

    return steps.select("gram", (F.log(prob("a", "na", "ta")) - F.log(prob("r", "nr", "tr"))).alias("delta"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, url_col: str = "url") -> DataFrame:
    """Every distinct URL (``_url``, a null one as empty) with ``host``, ``path``, ``rule``, ``score``,
    ``threshold`` and ``verdict``.

    URLs with a rule take its verdict and train the two character models over host and path: three
    quarters are counted, the last quarter calibrates. The score is the sum of log-likelihood
    differences by characters; the threshold is where the held-out allowed and blocked scores, as
    two normal curves, leave the same share on their wrong side. Other URLs are allowed at or above it.
    Where either kind is missing among the held-out URLs, the threshold is 0: the likelier model decides.
    """
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("_url")).distinct()
    urls = urls.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_said", _verdict_of(F.col("rule"), rules))
    urls = urls.withColumn("_s", F.concat("host", "path"))
    kept_out = F.conv(F.substring(F.md5("_url"), 1, 1), 16, 10).cast("int") < HELD_OUT
    learn = F.when(~kept_out, F.col("_said"))
    spread = _positions(urls.select("_url", "_s", learn.alias("_learn")), order)
    counts = spread.groupBy("gram").agg(F.count(F.when(F.col("_learn") == "allow", 1)).alias("a"), F.count(F.when(F.col("_learn") == "block", 1)).alias("r"))
    model = gram_scores(cut_lineage(counts), order)
    scored = attach(spread.select("_url", "gram"), model, ["gram"], "inner", salts=8)
    scored = scored.groupBy("_url").agg((F.sum("delta") / F.count(F.lit(1))).alias("score"))
    judged = cut_lineage(urls.drop("_s").join(scored, "_url").withColumn("score", F.round("score", 9)))
    held = judged.filter(kept_out & F.col("_said").isNotNull())
    a, r = (F.when(F.col("_said") == v, F.col("score")) for v in ("allow", "block"))
    cal = held.agg(F.avg(a).alias("ma"), F.avg(r).alias("mr"), (F.coalesce(F.stddev_pop(a), F.lit(0.0)) + 1e-6).alias("sa"), (F.coalesce(F.stddev_pop(r), F.lit(0.0)) + 1e-6).alias("sr"))
    cal = cal.select(F.coalesce((F.col("ma") * F.col("sr") + F.col("mr") * F.col("sa")) / (F.col("sa") + F.col("sr")), F.lit(0.0)).alias("threshold"))
    judged = judged.crossJoin(F.broadcast(cal))  # one row
    found = F.when(F.col("score") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block"))
    return judged.withColumn("verdict", F.coalesce("_said", found)).drop("_said")


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``judge`` joined back to the pages: id, ``url``, ``host``, ``path``, ``rule``, ``verdict``,
    ``score``, ``threshold``. Repeated rows are judged alike; an empty table gives no rows."""
    back = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    return back.join(judge(pages, rules, order, url_col), "_url").drop("_url")
