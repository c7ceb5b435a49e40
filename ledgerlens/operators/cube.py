"""Reports from a cube: one scan of the facts answers every additive report, filtered or not.

``build_cube`` writes two tables:

* ``sums``: exact partial sums per year x month x region x city x category x segment x
  discount tier. Their number is bounded by the dimensions, not by the facts;
* ``customers``: who bought, per year x region x category x segment, in a form that can be
  merged. Distinct counts do not add up, sets do. The exact form numbers the
  customers and keeps a bitmap for every block of 32,768 numbers
  (``bitmap_construct_agg``, merged by ``bitmap_or_agg``): distinct customers by any of
  the keys, or under any filter on them, without another scan of the facts. The
  approximate form keeps one HyperLogLog sketch per group (``hll_sketch_agg``, merged
  by ``hll_union_agg``), of the same size however many customers there are. A third
  form keeps the distinct customers themselves, without numbering them, for runs that
  ask by a few keys once.

Filters on year, region and category (``filter_cube``) select cells; the dashboard's
reports on them read no fact file.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import discount_tier, discount_tier_order, half_up, safe_div
from ledgerlens.operators import eda
from ledgerlens.operators.clean import filter_sales
from ledgerlens.operators.stats import global_row_number, share_of_total, top_n
from ledgerlens.session import scratch_path, sized_shuffles
from ledgerlens.sources.files import checkpoint_table

CELL_KEYS = [*eda.MONTH_KEYS, "region", "city", "category", "segment", "tier_order", "discount_tier"]
CUSTOMER_KEYS = ["year", "region", "category", "segment"]
#: log2 of the sketch's size: a standard error of 0.8 / sqrt(2**14), 0.7 %.
SKETCH_BITS = 14


class SalesCube(NamedTuple):
    sums: DataFrame
    customers: DataFrame


def numbered_customers(df: DataFrame) -> DataFrame:
    """(customer_id, no): all customers numbered from 1 in the order of their ids."""
    ids = df.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()
    return checkpoint_table(global_row_number(ids, ["customer_id"], "no"), "customer_numbers")


def customer_sets(df: DataFrame, keys: list[str] = CUSTOMER_KEYS, form: str = "bits") -> DataFrame:
    """Mergeable sets of customers per ``keys``: ``bits`` (keys, bucket, bits), ``sketch`` (keys, sketch) or
    ``ids`` (keys, customer_id).

    Facts collapse to (keys, customer) by partial aggregation before they meet the customers' numbers.
    """
    known = df.where(F.col("customer_id").isNotNull())
    if form == "sketch":
        return known.groupBy(*keys).agg(F.hll_sketch_agg("customer_id", F.lit(SKETCH_BITS)).alias("sketch"))
    ids = known.select(*keys, "customer_id").distinct()
    if form == "ids":
        return ids
    if form != "bits":
        raise ValueError(f"unknown form {form!r}")
    numbered = ids.join(numbered_customers(df), "customer_id").withColumn("bucket", F.bitmap_bucket_number("no"))
    # a set's customers meet before its bits are set: else each task holds a bitmap of 4 KB for nearly every set
    return (numbered.repartition(*keys, "bucket").groupBy(*keys, "bucket")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits")))


def distinct_customers(sets: DataFrame, *by: str) -> DataFrame:
    """(by, customers): distinct customers per ``by`` (one row without it), null keys kept."""
    none = F.lit(0).cast("long")
    if "sketch" in sets.columns:
        return sets.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), none).alias("customers"))
    if "customer_id" in sets.columns:
        return sets.groupBy(*by).agg(F.count_distinct("customer_id").alias("customers"))
    merged = sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), none).alias("customers"))


def cells(df: DataFrame) -> DataFrame:
    """The exact partial sums of the cube's cells."""
    tiers = {"tier_order": discount_tier_order("discount"), "discount_tier": discount_tier("discount")}
    return eda.partial_sums(df.withColumns(tiers), CELL_KEYS)


def build_cube(df: DataFrame, out: str | None = None, form: str = "bits") -> SalesCube:
    """The cube of a cleaned sales table, written below ``out`` (a new scratch folder if not given)."""
    out = out or scratch_path(df.sparkSession, "cube")
    with sized_shuffles(df):
        for name, table in {"sums": cells(df), "customers": customer_sets(df, form=form)}.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}")
    return read_cube(df.sparkSession, out)


def read_cube(spark, path: str) -> SalesCube:
    return SalesCube(*[spark.read.parquet(f"{path}/{name}") for name in SalesCube._fields])


def filter_cube(cube: SalesCube, years=None, regions=None, categories=None) -> SalesCube:
    """The cells that ``clean.filter_sales`` would fill from the rows it keeps."""
    return SalesCube(*[filter_sales(t, years, regions, categories) for t in cube])


def overview_cards(cube: SalesCube) -> DataFrame:
    total = cube.sums.agg(*eda.added_up())
    customers = distinct_customers(cube.customers).select("customers").scalar()
    return total.select(eda.amount("rev").alias("total_revenue"), eda.amount("prof").alias("total_profit"),
                        eda.mean_of("pm", "pm_n").alias("avg_margin"), F.coalesce("rows", F.lit(0)).alias("orders"),
                        eda.mean_of("rev", "rev_n").alias("avg_order_value"), F.coalesce(customers, F.lit(0)).alias("customers"))


def summary_stats(cube: SalesCube) -> DataFrame:
    def top(key: str):
        g = eda.sums_by(cube.sums, cube.sums, key)
        return top_n(g, [eda.amount("rev").desc(), F.col(key)], 1).select(key).scalar()

    customers = distinct_customers(cube.customers).select("customers").scalar()
    return cube.sums.agg(*eda.added_up()).select(
        eda.amount("rev").alias("total_revenue"), eda.amount("prof").alias("total_profit"),
        F.coalesce("rows", F.lit(0)).alias("total_orders"), F.coalesce(customers, F.lit(0)).alias("unique_customers"),
        eda.mean_of("rev", "rev_n").alias("avg_order_value"), eda.mean_of("pm", "pm_n").alias("avg_profit_margin"),
        top("category").alias("top_category"), top("region").alias("top_region"))


def _with_customers(cube: SalesCube, key: str) -> DataFrame:
    return eda.sums_by(cube.sums, cube.sums, key).join(distinct_customers(cube.customers, key), key, "left").withColumn(
        "customers", F.coalesce("customers", F.lit(0).cast("long")))


def region_performance(cube: SalesCube) -> DataFrame:
    return (_with_customers(cube, "region")
            .select("region", eda.amount("rev").alias("revenue"), eda.amount("prof").alias("profit"), "orders", "customers",
                    eda.mean_of("rev", "rev_n").alias("avg_order_value"))
            .orderBy(F.col("revenue").desc(), "region"))


def segment_analysis(cube: SalesCube) -> DataFrame:
    return (_with_customers(cube, "segment")
            .select("segment", eda.amount("rev").alias("revenue"), "orders", "customers")
            .withColumn("revenue_per_customer", half_up(safe_div("revenue", "customers"), 2))
            .orderBy(F.col("revenue").desc(), "segment"))


def category_performance(cube: SalesCube) -> DataFrame:
    g = eda.sums_by(cube.sums, cube.sums, "category").select(
        "category", eda.amount("rev").alias("revenue"), eda.amount("prof").alias("profit"), "orders",
        eda.mean_of("pm", "pm_n").alias("avg_margin"))
    return share_of_total(g, "revenue", "revenue_share", 4).orderBy(F.col("revenue").desc(), "category")


def city_performance(cube: SalesCube, n: int = 10) -> DataFrame:
    g = eda.sums_by(cube.sums, cube.sums, "region", "city").select("region", "city", eda.amount("rev").alias("revenue"))
    return top_n(g, [F.col("revenue").desc(), F.col("region"), F.col("city")], n)


def heatmap_data(cube: SalesCube, regions: list[str] | None = None) -> DataFrame:
    return eda.heatmap_data(cube.sums, regions, cube.sums)


def discount_impact(cube: SalesCube) -> DataFrame:
    return (eda.sums_by(cube.sums, cube.sums, "tier_order", "discount_tier")
            .select("tier_order", "discount_tier", eda.mean_of("pm", "pm_n").alias("avg_margin"),
                    eda.mean_of("rev", "rev_n").alias("avg_revenue"), "orders")
            .orderBy("tier_order"))


def monthly_sales_trend(cube: SalesCube) -> DataFrame:
    return eda.monthly_sales_trend(cube.sums, cube.sums)


def yoy_growth(cube: SalesCube) -> DataFrame:
    return eda.yoy_growth(cube.sums, cube.sums)


def monthly_avg_revenue(cube: SalesCube) -> DataFrame:
    return eda.monthly_avg_revenue(cube.sums, cube.sums)
