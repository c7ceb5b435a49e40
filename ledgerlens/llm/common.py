"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

SPACE = "\x20\t\n\x0b\x0c\r"                      # the white space of all contracts: 0x20 and 0x09-0x0D
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to a new folder under the shared checkpoint folder and read back.

    Later steps read files that every executor sees, so a lost executor costs
    one task and no step runs twice.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def majority_labels(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """One 0/1 label per key: the majority of its non-null rows, ties to 1; null keys dropped."""
    return (labels.where(F.col(key).isNotNull() & F.col(column).isNotNull())
            .groupBy(F.col(key).alias("label_id"))
            .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label")))
