"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 3) into a sink that reads
every column of every row; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from fleetkpi.queries import catalogue  # noqa: E402
from fleetkpi.session import local_session  # noqa: E402

HEADLINE = [
    "clean_visits",
    "time_between_failures",
    "trailing_visits",
    "system_recurrence",
    "tbf_last_five",
    "repair_hours_last_ten",
    "tbf_month_statistics",
    "machine_summary",
    "quality_report",
    "activity_heatmap",
    "riskiest_machines",
    "return_risk_rules",
    "return_training_set",
    "machine_state",
    "weibull_parameters",
    "remaining_life",
    "usage_series",
    "usage_forecast",
    "anomaly_features",
    "anomaly_rules",
    "anomaly_forest_scores",
    "anomaly_latest",
    "telemetry_closed_form",
    "telemetry_regressors",
    "telemetry_anomalies",
    "risk_projection",
    "combined_indicators",
    "executive_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "fleetkpi-bench")
    queries = catalogue()
    seconds = {}
    for name in names:
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
