"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from weir import workload

HEADLINE = ["scan_range", "scan_sum_all", "join2", "join3_chain", "join4_chain", "join_star", "join_many_to_many", "join_composite", "cyclic", "pkfk_eliminated", "eager_agg_3way", "group_sums"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = workload.queries(), {}
    for name in HEADLINE:
        known[name](spark, sf_dir).collect()  # code generation and statistics
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            known[name](spark, sf_dir).collect()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 4)
    batch = [workload.QUERIES[n] for n in HEADLINE if n in workload.QUERIES]
    began = time.perf_counter()
    workload.engine(spark, sf_dir).run_batch(batch)
    seconds["batch"] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(v for k, v in seconds.items() if k != "batch"), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
