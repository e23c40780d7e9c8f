"""Times the headline queries: one warm-up, then the median of three runs of each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans import registry  # noqa: E402
from graphloom.session import get_spark  # noqa: E402

NAMES = ["converged", "knn_join", "knn_topk", "bfs_levels", "pagerank", "connected_components", "log_stats_level", "log_stats_source", "log_stats_context", "payload_combo", "all_simple_paths", "transitive_closure", "tpch_q1_like", "bm25_topk", "mentions_edges", "proximity_neighbours", "proximity_topk", "index_knn_join", "spatial_join", "spatial_nearest", "supply_eccentricity"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("bench", f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in NAMES:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
