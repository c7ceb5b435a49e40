"""Incremental KPI parts with Structured Streaming, and the whole batch run."""

import os

from pyspark.sql import functions as F

from ledgerlens.operators import kpi
from ledgerlens.plans import queries as Q
from ledgerlens.plans.report import run_analysis
from ledgerlens.session import scratch_path
from ledgerlens.streaming import kpi_stream

SF = "/root/testdata/sf0.001"


def test_stream_folds_new_files_into_monthly_parts(spark):
    sales = Q.sales(spark, SF)
    src, parts, ckpt = (scratch_path(spark, n) for n in ("src", "parts", "ckpt"))
    first = sales.where(F.col("year") < 1998)
    second = sales.where(F.col("year") >= 1998)
    first.write.parquet(os.path.join(src, "batch=1"))
    kpi_stream.update_monthly_parts(spark, src, sales.schema, parts, ckpt)
    n1 = kpi_stream.read_monthly_parts(spark, parts).count()
    assert n1 == first.select("year_month").distinct().count()
    # a later scheduled run only reads the new files
    second.write.parquet(os.path.join(src, "batch=2"))
    kpi_stream.update_monthly_parts(spark, src, sales.schema, parts, ckpt)
    got = sorted(kpi_stream.kpi_history_from_parts(kpi_stream.read_monthly_parts(spark, parts)).collect())
    want = sorted(kpi.kpi_history(sales).collect())
    assert got == want


def test_run_analysis_writes_every_table(spark):
    raw = Q.raw(spark, SF)
    paths = run_analysis(spark, raw)
    clean = spark.read.parquet(paths["sales_clean"])
    assert clean.count() == 5865           # FIXTURES: clean rows at sf0.001
    for name in ("insights", "segment_summary", "forecast", "kpi_history", "order_histogram"):
        assert spark.read.parquet(paths[name]).count() > 0
    assert spark.read.parquet(paths["order_histogram"]).count() == 50
