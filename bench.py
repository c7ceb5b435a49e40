"""Benchmark: headline queries and the whole analysis run.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (timed runs per query, default 3), BENCH_RUNS (timed runs of the
whole analysis, default 5). Prints one JSON line.
Each query is forced with the ``noop`` sink (full computation, nothing
collected); the reported time is the median of the timed runs after one warm-up.
The headline metric is the whole analysis (clean the raw export, write it,
write every report table): median of the timed runs after a warm-up run; all of
them are listed. ``build_*`` are the shared tables that queries read, written
once. ``analysis_12k`` is the same analysis on 12,136 rows, the size that the
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.plans import queries as Q  # noqa: E402
from ledgerlens.plans.report import run_analysis  # noqa: E402
from ledgerlens.session import build_session, drop_scratch  # noqa: E402

HEADLINE = [
    "region_performance", "summary_stats", "monthly_sales_trend", "top_products", "category_performance",
    "top_customers", "heatmap_data", "discount_impact", "order_histogram", "customer_concentration",
    "rfm_segments", "segment_summary", "forecast", "kpi_alerts", "kpi_history", "insights",
    "clean_sales", "cleaning_audit", "data_quality_report",
]


SMALL_DIR = "/root/testdata/sf0.001"


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8), app_name="ledgerlens-bench")
    times = {}
    t0 = time.time()
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM / codegen warm-up
    times["session_warmup"] = round(time.time() - t0, 3)
    t0 = time.time()
    Q.sales(spark, sf_dir)            # star-schema join, written once
    times["build_sales"] = round(time.time() - t0, 3)
    t0 = time.time()
    Q.raw(spark, sf_dir)              # dirty export derived from the star schema
    times["build_raw_sales"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        fn = Q.REGISTRY[name]
        run(fn(spark, sf_dir))        # warm-up (and first-time writes of shared tables)
        runs = []
        for _ in range(repeat):
            t = time.time()
            run(fn(spark, sf_dir))
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
    for table, build in (("build_rfm", Q.rfm_table), ("build_clean", Q.clean_table)):
        t = time.time()
        run(build(spark, SMALL_DIR))      # of the small fixture: those of sf_dir were written above
        times[table + "_sf0.001"] = round(time.time() - t, 3)

    def analysis(raw, n):
        run_analysis(spark, raw)          # warm-up
        runs = []
        for _ in range(n):
            t = time.time()
            run_analysis(spark, raw)
            runs.append(round(time.time() - t, 3))
        return runs

    # whole analysis: clean the raw export, write it, write every report table
    raw = Q.raw(spark, sf_dir)
    runs = analysis(raw, int(os.environ.get("BENCH_RUNS", "5")))
    pipeline = round(statistics.median(runs), 3)
    times["analysis_pipeline"] = pipeline
    small = Q.raw(spark, SMALL_DIR)
    small = small.unionByName(small.withColumn("order_id", F.concat("order_id", F.lit("-2"))))
    small_runs = analysis(small, 3)
    times["analysis_12k"] = round(statistics.median(small_runs), 3)
    rows = raw.count()
    out = {"metric": "analysis_pipeline_wall_time", "value": pipeline, "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
           "analysis_runs": runs, "analysis_12k_runs": small_runs, "analysis_12k_rows": small.count(),
           "raw_rows": rows, "rows_per_sec": round(rows / pipeline, 1), "cpus": cpus,
           "headline_total_sec": round(sum(times[n] for n in HEADLINE), 3)}
    drop_scratch(spark)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
