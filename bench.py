"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (warm runs per query, median reported; default 3),
     BENCH_QUERIES (comma list to override the headline set).
Each query is executed to a noop sink (full computation, no output I/O).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_fault_labels",
    "w4_environment_rolling",
    "j1_w2_node_snapshot",
    "p16_w11_label_table",
    "p5_a4_edge_snapshot",
    "w8_future_horizon",
    "w7_expanding_threshold",
    "a15_univariate_summary",
    "a20_correlation_matrix",
    "m29_m30_ranking_metrics",
    "m32_pr_roc_curves",
    "w12_row_index",
    "m4_m6_design_matrix",
    "m7_m17_simple_regression",
    "m22_first_stump",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from driftkit.plans import registry
    from driftkit.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = registry.queries()
    times = {}
    for name in names:
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
