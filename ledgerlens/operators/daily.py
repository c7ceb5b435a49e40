"""KPIs from a daily table that grows by batches; late rows need no second look at the facts.

The table holds ``eda.partial_sums`` per day, one folder per batch of rows and month
(``batch=.../year_month=...``). A batch is written whole and under its own name, so
running it again replaces it and nothing is counted twice; rows that arrive late for
old days are just another batch, whose sums add up with the others when days are
read. ``compact`` folds finished batches into one. A trailing window reads the
folders of its months only: days, not order lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import eda

DAY_KEYS = ["date", "year_month"]


def day_sums(df: DataFrame) -> DataFrame:
    return eda.partial_sums(df, DAY_KEYS)


def _folder(path: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError(f"batch names are letters, digits and hyphens, not {batch!r}")
    return f"{path}/batch={batch}"


def add_batch(df: DataFrame, path: str, batch: str) -> None:
    """Add the sums of the rows of ``df`` as ``batch``; a batch of that name is replaced."""
    day_sums(df).hint("rebalance", "year_month").write.mode("overwrite").partitionBy("year_month").parquet(_folder(path, batch))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    amounts = {"rev": "decimal(38,6)", "prof": "decimal(38,6)", "pm": "decimal(38,8)", "disc": "decimal(38,8)"}
    names = ["rev", "rev_n", "prof", "orders", "rows", "pm", "pm_n", "disc", "disc_n"]
    schema = ("date date, " + ", ".join(f"{c} {amounts.get(c, 'long')}" for c in names)
              + ", last_date date, batch string, year_month string")
    return spark.read.schema(schema).parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """One row per day, over all batches (rows without a date as one more)."""
    return read_batches(spark, path).groupBy(*DAY_KEYS).agg(*eda.added_up())


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches, from the folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))


def compact(spark: SparkSession, path: str, out: str, batch: str = "compacted") -> str:
    """All batches of ``path`` as one batch of a new table ``out``; the old table stays as it is until it is not read any more."""
    read_days(spark, path).hint("rebalance", "year_month").write.mode("overwrite").partitionBy("year_month").parquet(
        _folder(out, batch))
    return out


def recent_days(days: DataFrame, window_months: int) -> DataFrame:
    """The rows of ``read_batches`` or ``read_days`` from the last date minus ``window_months`` on; both ends are
    subqueries, and folders of earlier months are not read."""
    dated = days.where(F.col("year_month").isNotNull())
    start = dated.agg(F.add_months(F.max("date"), -window_months).alias("start"))
    return dated.where((F.col("year_month") >= start.select(F.date_format("start", "yyyy-MM")).scalar())
                       & (F.col("date") >= start.scalar()))


def compute_kpis(days: DataFrame, window_months: int = 3) -> DataFrame:
    """``kpi.compute_kpis`` from days."""
    n = F.greatest(F.count_distinct("year_month"), F.lit(1)).cast("double")
    total = recent_days(days, window_months).agg(*eda.added_up(), n.alias("n"))
    return total.select((eda.amount("rev") / F.col("n")).alias("monthly_revenue"),
                        eda.mean_of("rev", "rev_n").alias("avg_order_value"),
                        eda.mean_of("pm", "pm_n").alias("profit_margin"),
                        (F.coalesce("rows", F.lit(0)).cast("double") / F.col("n")).alias("order_count"),
                        eda.mean_of("disc", "disc_n").alias("discount_rate"))
