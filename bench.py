"""Headline timings: prints one JSON line. Reads $BENCH_SF_DIR, runs on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import statistics
import time

from urlrisk.queries import queries
from urlrisk.session import build_session

HEADLINE = [
    "t_visit_features", "t_visit_gate", "e4_list_verdict", "f2_bloom_build", "f3_bloom_probe", "f10_trigram_similarity",
    "h7_closure", "i5_chain_summary", "j16_scan_b", "k3_top_k", "l9_distribution",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="urlrisk-bench")
    every = queries()
    urls = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    timings = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):  # the first run warms up and is not counted
            start = time.perf_counter()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "feature_urls_per_sec": round(urls / timings["t_visit_features"]),
        "gate_urls_per_sec": round(urls / timings["t_visit_gate"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
