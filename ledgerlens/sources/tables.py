"""Input tables: the star schema, and the flat sales tables derived from it.

The flat ``sales`` table (one row per order line) is built by joining the fact
table to its dimensions. Join order is written out because Catalyst does not
reorder joins without cost-based statistics:

* ``orders`` joins ``customer`` on the customer key: the order-sized side is
  shuffled, not the line-sized one;
* ``lineitem`` joins that on the order key (sort-merge on both large sides);
* ``part`` joins on the part key;
* nation and region join last: lines carry a nation's key through the shuffles
  and get the names, and all texts made of keys, when no shuffle is left.

Only the nations with their regions (25 rows at every size) are hinted for
broadcast, so that lines are never shuffled for them, unless the session has broadcasts
off (a threshold of -1); AQE turns any other join into a broadcast at run time only when
the measured side is small enough.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import half_up


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, pruned to the columns that are used."""
    return read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and nation key."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return orders.join(cust, orders.o_custkey == cust.c_custkey)


def with_places(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Names of nation and region by ``c_nationkey``."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    if not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):   # a session without broadcasts has none
        geo = F.broadcast(geo)                                               # nations do not grow with the sales
    return df.join(geo, df.c_nationkey == geo.n_nationkey)


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment, nation and region."""
    return with_places(spark, sf_dir, orders_of_customers(spark, sf_dir))


def with_parts(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines joined to all dimensions, columns pruned to what is used."""
    lines, orders = order_lines(spark, sf_dir), orders_of_customers(spark, sf_dir)
    return with_places(spark, sf_dir, with_parts(spark, sf_dir, lines.join(orders, lines.l_orderkey == orders.o_orderkey)))


def _order_id() -> F.Column:
    return F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"), F.lit("-"),
                    F.col("l_partkey").cast("string"), F.lit("-"),
                    F.col("l_suppkey").cast("string"))


def _priced(df: DataFrame) -> DataFrame:
    """unit price, tripled discount tier, margin, revenue, profit (all half-up)."""
    return (df
            .withColumn("_up", half_up(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), 2))
            .withColumn("_disc", F.floor(F.col("l_discount") * 100 + 0.5) * 3 / 100)
            .withColumn("_margin", F.lit(0.1) + F.col("l_tax") + F.col("p_size") / F.lit(200.0))
            .withColumn("_qty", F.col("l_quantity").cast("bigint"))
            .withColumn("_rev", half_up(F.col("_up") * F.col("_qty") * (F.lit(1) - F.col("_disc")), 2))
            .withColumn("_profit", half_up(F.col("_rev") * F.col("_margin"), 2)))


def _category() -> F.Column:
    return F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1 << 20)))


def sales_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean, typed ``sales`` table (FIXTURES section 3)."""
    return sales_of(_star_lines(spark, sf_dir))


def sales_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_from_star`` and the order's year as ``_year``, in whose order rows are inside each partition,
    to be written by year: keys and numbers are sorted, and the texts made of them afterwards."""
    lines = _star_lines(spark, sf_dir).withColumn("_year", F.year(F.col("o_orderdate").cast("date")))
    return sales_of(lines.sortWithinPartitions("_year"), "_year")


def sales_of(lines: DataFrame, *more: str) -> DataFrame:
    """``sales_from_star`` of order lines joined to all dimensions; ``more``: their columns to be kept."""
    df = _priced(lines)
    return df.select(
        _order_id().alias("order_id"),
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("p_name").alias("product"),
        _category().alias("category"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.col("_qty").alias("quantity"),
        F.col("_up").alias("unit_price"),
        F.col("_disc").alias("discount"),
        F.col("_rev").alias("revenue"),
        F.col("_profit").alias("profit"),
        *more,
    )


def raw_sales_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty, all-string ``raw_sales`` table (FIXTURES section 4).

    Deterministic defects keyed on ``k``: nulls, unparsable dates and
    quantities, negative quantities, lower-cased categories, and copied rows
    (some copies with other casing, which survive de-duplication).
    """
    d = (_priced(_star_lines(spark, sf_dir))
         .withColumn("k", F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")))
    # one row, or two; the joins run once
    d = d.withColumn("dup", F.explode(F.when(F.col("k") % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = F.col("k")
    return d.select(
        _order_id().alias("order_id"),
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(k % 50 != 3, F.col("c_mktsegment")).alias("segment"),
        F.when(k % 97 == 11, F.lit("not-a-date"))
         .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"),
        F.col("p_name").alias("product"),
        F.when((k % 60 == 5) | ((F.col("dup") == 1) & (k % 200 == 0)), F.lower("p_type"))
         .otherwise(F.col("p_type")).alias("category"),
        F.col("r_name").alias("region"),
        F.when(k % 50 != 29, F.col("n_name")).alias("city"),
        F.when(k % 101 == 7, F.lit("-1")).when(k % 103 == 9, F.lit("n/a"))
         .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.col("_up").cast("string").alias("unit_price"),
        F.when(k % 50 != 17, F.col("_disc").cast("string")).alias("discount"),
        F.col("_rev").cast("string").alias("revenue"),
        F.col("_profit").cast("string").alias("profit"),
    )
