"""Times the headline queries; prints one JSON line.

Each query is run once untimed (JVM warm-up, codegen) on the smallest scale and
then once timed, its full result written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dockflow.plans import forecast  # noqa: E402
from dockflow.session import build_session  # noqa: E402
from registry import all_queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = "/root/testdata/sf0.001"

HEADLINE = [
    "panel_10min",
    "duplicate_bars",
    "weekday_activity",
    "weekday_box",
    "daypart_usage",
    "slot_variability_top_per_station",
    "top_activity_ties",
    "monday_by_slot",
    "running_sum_reset",
    "heatmap_station",
    "daypart_free_docks",
    "interarrival",
    "queue_panel",
    "queue_params",
    "queue_bounds",
    "profile_wide",
    "profile_filled",
    "nearest_centroid",
    "kmeans_profiles",
    "station_sample",
    "halfhour_features",
    "train_test_split",
    "stock_verdict",
    "weather_corr",
    "rf_forecast",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    begin = time.perf_counter()
    action()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    only = sys.argv[1:]
    for name in only or HEADLINE:
        run(queries[name](spark, WARM_DIR))
        seconds[name] = timed(lambda: run(queries[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "forest": {"query": "rf_forecast", "trees": forecast.TREES, "depth": forecast.DEPTH},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
