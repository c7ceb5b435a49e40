"""The star join from buckets of the order key."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import queries as Q
from ledgerlens.sources import bucketed, tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


def joins(node, name):
    """The nodes of that kind in a physical plan."""
    found = [node] if node.nodeName() == name else []
    children = node.children()
    for i in range(children.size()):
        found += joins(children.apply(i), name)
    return found


def test_no_exchange_below_the_join_of_lines_and_orders(spark):
    star = bucketed.write_star(spark, SF, buckets=6)
    cold = spark.table(star.lines).join(spark.table(star.orders).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = plan_of(cold).toString()
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
    whole = bucketed.sales_from_buckets(spark, star)
    (join,) = [j for j in joins(plan_of(whole).inputPlan(), "SortMergeJoin") if "l_orderkey" in j.simpleString(100)]
    below = join.toString()
    assert "star_lines" in below and "star_orders" in below and "Exchange" not in below
    assert sorted(map(str, whole.collect())) == sorted(map(str, tables.sales_from_star(spark, SF).collect()))
    bucketed.drop_star(spark, star)
    assert not spark.catalog.tableExists(star.lines) and not spark.catalog.tableExists(star.orders)


def test_a_key_with_a_third_of_the_lines(spark):
    lines = tables.order_lines(spark, SF)
    key = lines.agg(F.min("l_orderkey")).first()[0]
    hot = F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(3)) == 0
    lines = lines.withColumn("l_orderkey", F.when(hot, F.lit(key)).otherwise(F.col("l_orderkey")))
    n, third = lines.count(), lines.where(F.col("l_orderkey") == key).count()
    assert third > n * 0.3
    star = bucketed.write_star(spark, SF, buckets=8, lines=lines)
    assert [r[0] for r in spark.read.parquet(star.hot_lines).select("l_orderkey").distinct().collect()] == [key]
    sizes = spark.table(star.lines).groupBy(F.pmod(F.hash("l_orderkey"), F.lit(8))).count().collect()
    assert max(r["count"] for r in sizes) < n / 4
    got = bucketed.ordered_lines(spark, star)
    orders = tables.orders_with_customers(spark, SF)
    want = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    bucketed.drop_star(spark, star)


@pytest.mark.parametrize("name", ["bucketed_star_join", "bucketed_region_performance"])
def test_queries_write_the_buckets_once(spark, name):
    Q.REGISTRY[name](spark, SF)
    before = len(spark.catalog.listTables())
    Q.REGISTRY[name](spark, SF)
    assert len(spark.catalog.listTables()) == before
