"""Benchmark the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to override the default set).

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver); the time per query is the
best of ``BENCH_REPEAT`` runs (default 1) after one warm-up pass of every
measured query over the sf0.001 tables (``BENCH_WARM_DIR``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notewise.plans.catalog import load_all  # noqa: E402
from notewise.session import build_session  # noqa: E402

HEADLINE = [
    "label_cohort",          # flagship: keyword cohort + exact control sample + clean + label
    "case_control_cohort",
    "cohort_match_bounded",
    "clean_text",
    "word_count_custom",
    "top_words_custom",
    "describe_numeric",
    "length_histogram",
    "keyword_filter",
    "split_three_way",
    "undersample_majority",
    "pr_curve",
    "roc_auc",
    "classification_report",
    "leaderboard",
    "smote_neighbors",
    "smote_oversample",
    "stream_cohort",
    "embed_text",            # one encoder
    "train_gbt",             # one fit (100 rounds) and its scores
    "attribution_summary",   # a fit and Shapley values
    "permutation_importance",  # a fit and 65 scorings
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    reg = load_all()
    # Warm-up on the smallest tables: JVM class loading, JIT and codegen
    # paths of every measured query, without touching the measured data.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            reg[name].fn(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
