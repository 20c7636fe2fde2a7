"""Headline queries, timed warm on one machine; prints one JSON line.

Each query writes all its rows to the no-op sink. The first run of a query pays
for code generation and is left out of the figure; both are reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sunloom.session import local_session
from sunloom.workload import QUERIES

HEADLINE = [
    "route_message_type", "bronze_projection", "validate_inverter", "efficiency_flag", "upsert_keep_latest", "inverter_hourly", "inverter_daily",
    "poi_hourly", "meteo_daily", "plant_hourly_summary", "plant_daily_summary", "unaggregated_inverter_hours", "failure_daily_summary",
    "asof_nearest", "failures_active_at", "system_impact", "lag_features", "rolling_features", "ffill_bfill", "resample_interpolate",
    "seasonal_decompose", "ewma", "chrono_split", "gap_stats", "iqr_outliers", "confusion_metrics", "standardize", "threshold_alerts",
    "forecast_vs_actual", "alerts_union",
]


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "sunloom-bench", os.environ.get("BENCH_MEMORY", "8g"))
    cold, warm = {}, {}
    for name in names:
        query = QUERIES[name]
        cold[name] = round(timed(query, spark, sf_dir), 3)
        warm[name] = round(min(timed(query, spark, sf_dir) for _ in range(2)), 3)
    total = round(sum(warm.values()), 3)
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": total, "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
