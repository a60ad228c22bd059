"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` picks the tables (default /root/testdata/sf0.1) and ``BENCH_CPUS`` the local
cores. A query is timed from building its frame to writing all its rows to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfcast.catalog import REGISTRY  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

HEADLINE = [
    "prepared_panel", "supervised_frame", "inference_with_fallback", "series_summary", "numeric_summary",
    "seasonal_naive", "forecast_origins", "series_cost_profile", "cost_summary", "cost_sensitivity",
    "order_up_to_ledger", "capacity_allocation", "prediction_summary", "conformal_quantiles",
    "population_stability", "series_stability", "page_hinkley", "imputation_quality", "reorder_recommendations",
    "sku_table", "rolling_origin_backtest", "cadence_comparison",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          driver_memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["date_ordinals"].fn(spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        REGISTRY[name].fn(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
