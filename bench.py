"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores.  Every query runs
``BENCH_RUNS`` times after one warm-up and reports its median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnbook.plans import REGISTRY  # noqa: E402
from turnbook.session import build_session  # noqa: E402

HEADLINE = [
    "ranking_heat",
    "ranking_acceleration",
    "ranking_full_export",
    "export_rankings",
    "kline",
    "export_kline",
    "revenue_latest",
    "revenue_history",
    "index_ytd",
    "volume_curve",
    "monotonic_gate",
    "ranking_intraday",
    "reconcile",
    "regular_quotes",
    "sync_incremental",
    "stream_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(cores=cores, app="bench", shuffle_partitions=max(8, int(cores)))
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
