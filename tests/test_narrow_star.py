"""The star join shuffles keys and numbers; names of places and texts come after the shuffles."""

import glob
import re

from pyspark.sql import functions as F

from ledgerlens.plans import queries as Q
from ledgerlens.plans.materialize import materialized_path
from ledgerlens.sources import tables

SF = "/root/testdata/sf0.001"


def nodes(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]


def test_raw_sales_read_the_lines_once(spark):
    scans = [x for x in nodes(tables.raw_sales_from_star(spark, SF)) if "FileScan" in x and "l_orderkey" in x]
    assert len(scans) == 1


def test_copies_of_raw_rows(spark):
    """As many second rows as lines whose key asks for one; lines without a key have none."""
    raw = tables.raw_sales_from_star(spark, SF)
    k = F.split("order_id", "-")
    k = k[1].cast("long") * 7 + k[2].cast("long") * 13 + k[3].cast("long")
    n, copies = raw.count(), tables._star_lines(spark, SF).where((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
                                                                 + F.col("l_partkey")) % 100 == 0).count()
    assert copies > 0 and n == tables.sales_from_star(spark, SF).count() + copies
    assert raw.where(k % 100 == 0).count() == 2 * copies


def test_places_are_joined_after_the_last_large_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")         # the large tables meet by sort-merge join
    try:
        plan = nodes(tables.sales_from_star(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = [m[0] for x in plan for m in re.finditer(r"\w+Join \[(c_nationkey|l_partkey|l_orderkey)\b", x)]
    assert found == ["BroadcastHashJoin [c_nationkey", "SortMergeJoin [l_partkey", "SortMergeJoin [l_orderkey"], found


def test_sales_are_written_by_year_without_shuffling_or_sorting_whole_rows(spark):
    df = Q.build_sales_by_year(spark, SF)
    assert not any("REBALANCE" in x for x in nodes(df))
    want = Q.build_sales(spark, SF)
    assert df.columns == want.columns and df.schema["year"].dataType == want.schema["year"].dataType
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    written = Q.sales(spark, SF)
    assert written.count() == want.count()
    assert glob.glob(materialized_path(spark, "sales", SF).removeprefix("file:") + "/year=*/*.zstd.parquet")
