"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (names, comma separated).
Every query runs to its last row, three times after a warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gradus import checks  # noqa: E402

HEADLINE = (
    "a4_dimension_rule_counts", "a5_fact_rule_counts", "a15_group_stats", "l1_first_per_key", "q2_star_metrics",
    "q3_feature_report", "m4_stratified_split", "m6_gnb_fit", "m8_predicted_probability", "m9_smote_rows",
    "m11_cross_validation", "m11_cross_validation_smote", "m12_binary_metrics", "m15_holdout_smote",
    "m23_batch_predictions", "x1_standardized_tables", "x5_inference_run", "x6_end_to_end",
)

_RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("gradus-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        checks.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("m8_predicted_probability", "m9_smote_rows"):
        run(name)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(_RUNS)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(folder.rsplit("sf", 1)[-1]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
