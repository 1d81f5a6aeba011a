"""Time the headline queries: one JSON line, warm median of three runs per query.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every result row is computed and
handed to Spark's noop sink, so nothing is collected and nothing is skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from marketlens.registry import QUERIES
from marketlens.sources.scratch import scratch_run

HEADLINE = [
    "payment_summary",
    "item_summary",
    "fact_orders",
    "customer_features",
    "category_daily_sales",
    "state_category_daily_sales",
    "customer_repeat_features",
    "ab_test_sample",
    "kpi_summary",
    "top_categories",
    "state_category_mix",
    "dq_referential_integrity",
    "dq_null_rates",
    "daily_series",
    "forecast_moving_average",
    "propensity_bands",
    "topk_lift",
    "roc_auc",
    "welch_test",
    "dq_report",
    "stratified_split",
    "segment_customers",
    "propensity_model_scores",
    "r_learner_scores",
]
RUNS = 3


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marketlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            with scratch_run(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_warm_median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
