"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up code generation and Python workers, then is timed writing its full
result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "classification_metrics", "average_precision", "calibration_error", "compare_arms", "churn", "threshold_sweep",
    "rbf_mmd2", "coral_distance", "bbse", "holm", "stratified_kfold", "content_diff", "tile_stats", "bootstrap_paired_ci",
)


def main() -> None:
    from gradeline.plans import catalog
    from gradeline.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus, cpus, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in only:
        for attempt in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    predictions = spark.read.parquet(f"{folder}/orders.parquet").count() * 125
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "prediction_rows": predictions,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
