"""Headline queries in seconds, one JSON line: ``python bench.py``.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores; each query is materialised in
full through the no-op sink, after one warm-up query that is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuewright.plans import load_queries  # noqa: E402
from cuewright.session import local_session  # noqa: E402

HEADLINE = (
    "flt10_rollup_status", "fn1_norm_keep", "jn0_interval_join", "jn1_kept", "jn5_asof", "jn10_to_output", "jn12_clip_cues",
    "win1_runs", "win5_merge_overlaps", "win6_complement", "win18_shots", "win20_rolling_median", "win7_repeated_words",
    "seg6_greedy_captions", "ag3_post_rates", "ag5_typical_post", "ag8_patterns", "top1_rank_posts", "ag9_duplicate_files",
    "jn20_merge_assets", "ag13_dominant_speaker", "jn14_token_diff",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load_queries()

    def run(name: str) -> float:
        begin = time.time()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - begin, 3)

    run("fn3_norm_key")
    times = {name: run(name) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
