"""The star's two large tables written in buckets of the order key, so that their join,
the largest of all, needs no shuffle however often the sales are built.

``write_star`` writes order lines and orders (with their customer's segment, nation and region) with the
same number of buckets, each bucket sorted by the key and in one file. Joins of the
two read bucket with bucket.

A bucket cannot be split when it is read, so order keys with a large share of the
lines are kept out of the buckets: keys with more than ``1 / (HOT_SHARE * buckets)`` of
all lines, of which there are fewer than ``HOT_SHARE * buckets`` at any size, go to a table
of their own, split like any other file, and meet their orders in a broadcast join.

The tables are registered in the session's catalog under new names; ``drop_star`` removes them.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path
from ledgerlens.sources import tables

#: Of the lines' files. A task sorts a bucket of lines and of orders in memory, where they take some ten times that.
BUCKET_BYTES = 16 << 20
HOT_SHARE = 4


class BucketedStar(NamedTuple):
    """Names of the bucketed tables, and folders of the hot keys' lines and orders."""
    lines: str
    orders: str
    hot_lines: str
    hot_orders: str
    part_dir: str


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, from the optimizer's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_star(spark: SparkSession, sf_dir: str, out: str | None = None, buckets: int | None = None,
               lines: DataFrame | None = None) -> BucketedStar:
    """``lines``: order lines in place of the table's (for tests)."""
    out = out or scratch_path(spark, "bucketed-star")
    lines = tables.order_lines(spark, sf_dir) if lines is None else lines
    orders = tables.orders_with_customers(spark, sf_dir)
    buckets = buckets or max(8, -(-input_bytes(lines) // BUCKET_BYTES))
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    limit = lines.agg(F.count(F.lit(1)) / (HOT_SHARE * buckets)).scalar()
    counts.where(F.col("n") > F.greatest(limit, F.lit(1.0))).select("l_orderkey").write.mode("overwrite").parquet(f"{out}/hot_keys")
    hot = F.broadcast(spark.read.parquet(f"{out}/hot_keys"))                # fewer than HOT_SHARE * buckets rows
    name = uuid.uuid4().hex[:12]
    star = BucketedStar(f"star_lines_{name}", f"star_orders_{name}", f"{out}/hot_lines", f"{out}/hot_orders", sf_dir)
    is_hot = F.col("o_orderkey") == F.col("l_orderkey")
    lines.join(hot, "l_orderkey", "left_semi").write.mode("overwrite").parquet(star.hot_lines)
    orders.join(hot, is_hot, "left_semi").write.mode("overwrite").parquet(star.hot_orders)
    for table, key, df in ((star.lines, "l_orderkey", lines.join(hot, "l_orderkey", "left_anti")),
                           (star.orders, "o_orderkey", orders.join(hot, is_hot, "left_anti"))):
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{out}/{table}")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return star


def ordered_lines(spark: SparkSession, star: BucketedStar) -> DataFrame:
    """Lines with their orders: bucket by bucket, and the hot keys' lines by broadcast."""
    cold = spark.table(star.lines).join(spark.table(star.orders).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    hot_orders = F.broadcast(spark.read.parquet(star.hot_orders))           # of fewer than HOT_SHARE * buckets keys
    hot = spark.read.parquet(star.hot_lines).join(hot_orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return cold.unionByName(hot)


def sales_from_buckets(spark: SparkSession, star: BucketedStar) -> DataFrame:
    """``tables.sales_from_star`` from the bucketed tables."""
    return tables.sales_of(tables.with_parts(spark, star.part_dir, ordered_lines(spark, star)))


def drop_star(spark: SparkSession, star: BucketedStar) -> None:
    """Take the tables out of the catalog (their files stay where they were written)."""
    for name in (star.lines, star.orders):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
