"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=4 python bench.py

Each query is run to completion with the no-op sink (full execution, nothing
collected), once to warm up and then BENCH_REPEAT times (default 3); the
median is reported.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "category_share", "daily_sales", "top_products", "table_occupancy", "station_queue",
    "order_summary", "daily_training", "assoc_rules", "basket_recommendations", "campaign_top",
    "apply_payments", "merge_active_orders", "cart_fold", "weather_asof", "segment_profile",
    "stream_table_state", "smart_basket", "dashboard_recommendations",
]


def main() -> None:
    from tavola.plans import QUERIES
    from tavola.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = HEADLINE
    if os.environ.get("BENCH_QUERIES"):
        keys = os.environ["BENCH_QUERIES"].split(",")
    spark = get_session(f"local[{cpus}]", app="tavola-bench", shuffle_partitions=max(8, 2 * cpus))
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    for k in keys:
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        times[k] = round(statistics.median(runs), 3)
        print(f"{k}: {times[k]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
