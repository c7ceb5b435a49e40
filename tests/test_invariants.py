"""Invariants over the fixture and plan-shape checks for scale."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import eda, forecast, rfm
from ledgerlens.operators.stats import global_row_number
from ledgerlens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sales(spark):
    return Q.sales(spark, SF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_do_not_depend_on_partitioning(sales):
    a = sorted(eda.region_performance(sales.coalesce(1)).collect())
    b = sorted(eda.region_performance(sales.repartition(13, "order_id")).collect())
    assert a == b
    c = sorted(rfm.compute_rfm(sales.repartition(11)).collect())
    d = sorted(rfm.compute_rfm(sales.coalesce(1)).collect())
    assert c == d


def test_totals_agree_across_groupings(sales):
    total = sales.agg(F.sum(F.col("revenue").cast("decimal(18,2)"))).first()[0]
    for df, col in [(eda.region_performance(sales), "revenue"), (eda.category_performance(sales), "revenue"),
                    (eda.monthly_sales_trend(sales), "revenue")]:
        s = df.agg(F.sum(F.col(col).cast("decimal(18,2)"))).first()[0]
        assert s == total


def test_shares_and_segments(sales):
    shares = [r.revenue_share for r in eda.category_performance(sales).collect()]
    assert sum(shares) == pytest.approx(1.0, abs=1e-3)
    summ = rfm.segment_summary(rfm.compute_rfm(sales)).collect()
    assert sum(r.customers for r in summ) == sales.select("customer_id").distinct().count()


def test_seasonal_index_mean_is_one(sales):
    idx = [r.seasonal_index for r in forecast.seasonal_index(forecast.decompose(forecast.monthly_series(sales))).collect()]
    assert sum(idx) / len(idx) == pytest.approx(1.0, abs=1e-9)


def test_scan_prunes_columns_and_pushes_filters(spark, sales):
    plan = _plan(eda.region_performance(sales))
    read = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert read and all("product" not in line for line in read)
    from ledgerlens.operators.clean import filter_sales
    fplan = _plan(filter_sales(sales, [1996], ["ASIA"], ["Promo"]).select("revenue"))
    assert "PushedFilters: [" in fplan and "In(region" in fplan or "EqualTo(region" in fplan


def test_distributed_rank_uses_range_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    out = global_row_number(df, ["g", "k"])
    plan = _plan(out)
    # rows were range-partitioned and written with their partition id; numbering
    # is a window per partition id, never one window over all rows
    assert "hashpartitioning(_pid" in plan and "Window" in plan
    assert sorted(r.rn for r in out.collect()) == list(range(1, 1001))


def test_star_join_broadcasts_nothing_without_a_size(spark):
    """With broadcasting by size off, every join of the star must be a sort-merge join:
    no table is broadcast by a hint."""
    from ledgerlens.sources.tables import sales_from_star
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(sales_from_star(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _scans(df, table="sales"):
    df.collect()
    return _plan(df).split("+- == Initial Plan ==")[0].count("FileScan")


def test_reports_scan_the_facts_once(spark, sales):
    from ledgerlens.operators import clean
    assert _scans(clean.filter_options(sales)) == 1
    assert _scans(eda.region_performance(sales)) == 1


def test_kpi_window_reads_no_older_years(spark, sales):
    from ledgerlens.operators import kpi
    plan = kpi.compute_kpis(sales, 3)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("year" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)


def test_forecast_reads_the_written_series_not_the_facts(sales):
    plan = _plan(forecast.forecast(sales, 6))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert schemas and all("revenue" not in line for line in schemas)


def test_insights_scan_only_the_written_aggregates(sales):
    from ledgerlens.operators.insights import insights
    plan = _plan(insights(sales))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("profit_margin" not in line for line in scans)
