"""Reports from the cube against the same reports from the facts."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cube, eda
from ledgerlens.operators.clean import filter_sales
from ledgerlens.plans import queries as Q

SF = "/root/testdata/sf0.001"
FILTERS = [(None, None, None), ([1996, 1998], ["ASIA"], None), (None, None, ["Promo", "Large"]), ([], None, None), ([2000], ["EUROPE"], ["Economy"])]


@pytest.fixture(scope="module")
def tables(spark):
    """The sales with nulls in every key and amount, and a customer with a third of the rows."""
    s = Q.sales(spark, SF)
    h = F.abs(F.hash("order_id"))
    s = s.withColumn("customer_id", F.when(h % 3 == 0, "HOT").otherwise(F.col("customer_id")))
    for i, c in enumerate(["customer_id", "region", "city", "category", "segment", "discount", "revenue", "profit_margin"]):
        s = s.withColumn(c, F.when(h % 53 != i, F.col(c)))
    path = Q._scratch(spark, "cube-test")
    s.write.parquet(path)
    s = spark.read.parquet(path)
    return s, {form: cube.SalesCube(cube.build_cube(s).sums, cube.customer_sets(s, form=form)) for form in ("bits", "ids")}


@pytest.mark.parametrize("form", ["bits", "ids"])
@pytest.mark.parametrize("years, regions, categories", FILTERS)
def test_filtered_reports_equal_those_of_the_rows(tables, form, years, regions, categories):
    sales, cubes = tables
    rows, cells = filter_sales(sales, years, regions, categories), cube.filter_cube(cubes[form], years, regions, categories)
    for report in ("overview_cards", "region_performance", "segment_analysis", "category_performance", "city_performance",
                   "discount_impact", "monthly_sales_trend", "yoy_growth", "monthly_avg_revenue"):
        want, got = getattr(eda, report)(rows), getattr(cube, report)(cells)
        assert got.columns == want.columns
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], report


def test_whole_reports_equal_those_of_the_rows(tables):
    sales, cubes = tables
    for report in ("summary_stats", "heatmap_data"):
        want, got = getattr(eda, report)(sales), getattr(cube, report)(cubes["bits"])
        assert got.columns == want.columns and got.collect() == want.collect()


def test_no_report_reads_the_facts(spark):
    cells = Q.filtered_cube(spark, SF)
    for report in ("overview_cards", "region_performance", "monthly_sales_trend", "summary_stats", "discount_impact"):
        files = getattr(cube, report)(cells).inputFiles()
        plan = getattr(cube, report)(cells)._jdf.queryExecution().executedPlan().toString()
        assert files and all("/cube-" in f for f in files)
        assert "/sales-" not in plan
    scans = [x for x in cube.monthly_sales_trend(cells)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert scans and all("In(year" in x and "In(region" in x for x in scans)


def test_customers_beyond_one_bitmap_merge_exactly(spark):
    """70,000 customers in three bitmaps, each in several overlapping groups."""
    n = 70_000
    df = (spark.range(n * 3).select((F.col("id") % n).cast("string").alias("customer_id"), (F.col("id") % 7).alias("a"),
                                    (F.col("id") % 5).alias("b"), F.lit("x").alias("c")))
    sets = cube.customer_sets(df, ["a", "b", "c"]).cache()
    assert sets.select("bucket").distinct().count() == 3
    for by in (["a"], ["b"], ["a", "b"], ["c"], []):
        want = df.groupBy(*by).agg(F.count_distinct("customer_id").alias("customers"))
        assert sorted(cube.distinct_customers(sets, *by).collect()) == sorted(want.collect())
    part = cube.distinct_customers(sets.where("a < 3"), "b").collect()
    assert sorted(part) == sorted(df.where("a < 3").groupBy("b").agg(F.count_distinct("customer_id")).collect())
    sets.unpersist()


def test_sketches_merge_within_their_error(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).cast("string").alias("customer_id"), (F.col("id") % 64).alias("a"),
                                     (F.col("id") % 3).alias("b"))
    sets = cube.customer_sets(df, ["a", "b"], "sketch")
    assert sets.count() == 192
    for by in (["a"], ["b"], []):
        want = {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).agg(F.count_distinct("customer_id").alias("n")).collect()}
        for r in cube.distinct_customers(sets, *by).collect():
            exact = want[tuple(r)[:-1]]
            assert abs(r.customers - exact) <= 0.035 * exact          # five standard errors


def test_empty_facts(spark):
    empty = Q.sales(spark, SF).where("false")
    for form in ("bits", "sketch", "ids"):
        cells = cube.SalesCube(cube.cells(empty), cube.customer_sets(empty, form=form))
        assert cube.overview_cards(cells).collect() == eda.overview_cards(empty).collect()
        assert cube.region_performance(cells).collect() == []
    with pytest.raises(ValueError):
        cube.customer_sets(empty, form="list")
