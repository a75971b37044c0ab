"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables (default sf0.1), BENCH_CPUS the number
of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tsengine.plans.catalog import QUERIES
from tsengine.session import build_session

HEADLINE = [
    "evaluate_run", "evaluate_panel", "evaluate_long_horizon", "prepare_split", "windows_marks", "scale_transform",
    "row_index", "split_rows", "metric_bundle", "metric_corr", "batch_mean_loss", "forecast_recursive",
    "forecast_direct_one_lag", "forecast_direct", "forecast_sigma", "score_windows", "select_forecaster", "trend_season",
    "point_adjust", "early_stop_epoch", "time_features_h", "sinusoid_calendar", "instance_norm", "patchify",
    "scan_series_rows", "info_series_join", "holdout_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
