"""Headline queries, timed end to end; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [key ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["wafer_summary", "fail_neighbors", "fail_clusters", "segment_pattern", "pattern_area", "radial_profile", "feature_matrix",
            "near_duplicate_pairs", "leakage_groups", "full_report", "group_bootstrap_ci", "crossfit_route", "drift_scopes", "mann_whitney", "rootcause_report"]


def main() -> None:
    from diegrid.plans import catalog
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * cpus))
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()     # JVM and page cache
    times: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.time()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
