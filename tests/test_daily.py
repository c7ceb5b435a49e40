"""KPIs from daily sums with late rows, and writing again only the years that changed."""

import datetime
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import daily, kpi
from ledgerlens.plans import queries as Q
from ledgerlens.session import scratch_path
from ledgerlens.sources.files import write_clean

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sales(spark):
    return Q.sales(spark, SF)


@pytest.mark.parametrize("window", [1, 3, 12])
def test_late_rows_and_repeated_batches(spark, sales, window):
    path = scratch_path(spark, "days")
    late = F.pmod(F.hash("order_id"), F.lit(5)) == 0
    daily.add_batch(sales.where(~late), path, "b1")
    before = daily.compute_kpis(daily.read_batches(spark, path), window).collect()
    assert before == kpi.compute_kpis(sales.where(~late), window).collect()
    daily.add_batch(sales, path, "b2")                       # a wrong run,
    daily.add_batch(sales.where(late), path, "b2")           # repeated
    want = kpi.compute_kpis(sales, window).collect()
    assert daily.batches(spark, path) == ["b1", "b2"]
    assert daily.compute_kpis(daily.read_batches(spark, path), window).collect() == want
    assert daily.compute_kpis(daily.read_days(spark, path), window).collect() == want
    small = daily.compact(spark, path, scratch_path(spark, "days"))
    assert daily.batches(spark, small) == ["compacted"]
    assert daily.compute_kpis(daily.read_batches(spark, small), window).collect() == want
    assert daily.read_batches(spark, small).count() == sales.select("date").distinct().count()


def test_window_reads_the_folders_of_its_months(spark, sales):
    path = scratch_path(spark, "days")
    daily.add_batch(sales, path, "b1")
    k = daily.compute_kpis(daily.read_batches(spark, path), 3)
    assert k.first().order_count > 0
    plan = k._jdf.queryExecution().executedPlan().toString()
    main = [x for x in plan.splitlines() if "FileScan" in x and "rev" in x]
    assert main and all("year_month" in x.split("PartitionFilters: [")[1].split("]")[0] for x in main)
    assert "customer_id" not in plan


def test_days_of_nothing_and_rows_without_a_date(spark, sales):
    path = scratch_path(spark, "days")
    daily.add_batch(sales.where("false"), path, "none")
    daily.add_batch(sales.limit(0), path, "none-2")
    undated = sales.limit(3).withColumn("date", F.lit(None).cast("date")).withColumn("year_month", F.lit(None).cast("string"))
    daily.add_batch(undated, path, "undated")
    assert daily.compute_kpis(daily.read_batches(spark, path)).collect() == kpi.compute_kpis(sales.where("false")).collect()
    with pytest.raises(ValueError, match="batch"):
        daily.add_batch(undated, path, "a/b")


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), {})[n] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return out


def test_a_second_run_of_one_year_leaves_the_others(spark, sales, tmp_path):
    path = str(tmp_path / "clean")
    write_clean(sales, path, sort_by=["region", "date"])
    first = files(path)
    again = sales.where("year = 1997").withColumn("quantity", F.col("quantity") + 1)
    for _ in range(2):
        write_clean(again, path, touched_only=True, sort_by=["region", "date"])
    second = files(path)
    assert {y: f for y, f in first.items() if y != "year=1997"} == {y: f for y, f in second.items() if y != "year=1997"}
    assert not set(first["year=1997"]) & set(second["year=1997"])
    back = spark.read.parquet(path)
    want = sales.agg(F.sum("quantity")).first()[0] + again.count()
    assert back.count() == sales.count() and back.agg(F.sum("quantity")).first()[0] == want
    with pytest.raises(ValueError, match="partition"):
        write_clean(sales, path, partition_by=None, touched_only=True)


def test_rows_are_in_order_inside_the_files(spark, sales, tmp_path):
    path = str(tmp_path / "clean")
    write_clean(sales, path, sort_by=["region", "date"])
    for folder, names in files(path).items():
        for n in names:
            rows = pq.read_table(os.path.join(path, folder, n), columns=["region", "date"], partitioning=None).to_pylist()
            keys = [(r["region"], r["date"]) for r in rows]
            assert keys == sorted(keys) and isinstance(keys[0][1], datetime.date)
