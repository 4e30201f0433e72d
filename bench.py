"""Wall time of the headline queries; prints one JSON line.

Each query runs to completion over its whole result (no rows are collected). The stored tables that
the later queries read are built and timed first, as ``store_processed`` and ``store_validation``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from skybias import build_session
from skybias.plans import QUERIES
from skybias.plans.domain import domain

HEADLINE = [
    "sensors_within_radius", "top_k_sensors", "job_observations", "hourly_mean", "distance_weighted_mean",
    "iqr_outlier_filter", "interpolate_gaps", "upsample_linear", "differentiate_accumulated", "job_forecasts",
    "processed_table", "hourly_bias", "sliding_samples", "build_dataset", "scale_series", "build_validation", "score_runs",
    "score_series", "box_stats_hour_type", "error_histogram_hour", "error_density", "correlation_matrix",
    "availability_report", "improvement_report", "weighted_corr", "fit_elastic_net"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads

    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    tables = domain(spark, sf_dir)
    timed("store_processed", lambda: tables.processed)
    timed("store_validation", lambda: tables.validation)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
