"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is executed in full into Spark's no-op sink (nothing is pulled
to the driver), after one warm-up query that starts the JVM and Python
workers."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_top_k",
    "tfidf_top_k_2gr",
    "cosine_top_k_block",
    "batch_retrieve",
    "prepare_retrieval_task",
    "evaluate_run",
    "pair_word_edit_distance",
    "pair_lcs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from quarry.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          app_name="quarry-bench")
    from quarry.plans.catalog import QUERIES

    # warm-up (JIT, Python workers) on the smallest tables when present
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    for name in ("bm25_top_k", "pair_lcs", "cosine_top_k_block"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
