"""Incremental KPI monitoring with Structured Streaming.

The KPI check is meant to be re-run on a schedule as new order files land.
Instead of recomputing from all history each time, a streaming aggregation
keeps the per-month exact sums and counts (``kpi.monthly_kpi_parts``) in its
state store, one row per month, and each run (``availableNow`` trigger)
folds in only the files that arrived since the last run. The monthly table is
written whole after every micro-batch (complete mode: its size is the number
of months) to a folder of its own, named by the batch; readers take the newest
finished one, so they never see a table that is being replaced, and a batch that
is run again writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import kpi


def update_monthly_parts(spark: SparkSession, source_dir: str, schema, parts_dir: str,
                         checkpoint_dir: str) -> None:
    """Fold newly arrived parquet files under ``source_dir`` into the monthly
    parts table at ``parts_dir``; returns when all available files are done."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{parts_dir}/batch-{batch_id:012d}")

    q = (kpi.monthly_kpi_parts(stream).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint_dir)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()


def read_monthly_parts(spark: SparkSession, parts_dir: str) -> DataFrame:
    """The newest finished monthly table under ``parts_dir``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parts_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(
        f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(p.toString() for p in done))


def kpi_history_from_parts(parts: DataFrame, targets: dict | None = None, months: int = 3) -> DataFrame:
    """KPI history (same table as ``kpi.kpi_history``) from the monthly parts."""
    return kpi.kpi_history_from_parts(parts, targets, months)
