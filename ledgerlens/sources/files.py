"""File sources and sinks: header CSV and parquet in, parquet/CSV out.

Raw input is always read with every column as a string (never inferred); the
cleaning operators cast it with ``try_cast`` semantics afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.constants import NULL_TOKENS


def csv_dialect() -> dict:
    """Quotes are doubled inside quoted fields, as spreadsheet exports write them."""
    return {"quote": '"', "escape": '"'}


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line, read by Spark from the files."""
    first = spark.read.options(header=False, inferSchema=False, **csv_dialect()).csv(path).limit(1).collect()
    return [c if c is not None else f"_c{i}" for i, c in enumerate(first[0])] if first else []


def read_sales_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV -> all-string DataFrame with the header names kept verbatim.

    Every token in ``NULL_TOKENS`` becomes null, as a pandas-style reader would.
    Columns are not renamed here: ``standardize_columns`` does that. All files
    must carry the same header, and every row as many fields as the header has;
    anything else raises instead of moving values to other columns
    (``sources.load.load_sales`` fills short rows and sets the others aside).
    ``multi_line`` allows line breaks inside quoted fields; such files cannot be
    split, so each is read by one task.
    """
    names = header_names(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).options(
        header=True, enforceSchema=False, mode="FAILFAST", multiLine=multi_line, columnPruning=False,
        **csv_dialect()).csv(path)
    return df.select(*[
        F.when(~F.col(f"`{n}`").isin(NULL_TOKENS), F.col(f"`{n}`")).alias(n)
        for n in names])


def read_sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "year",
                touched_only: bool = False, sort_by: list[str] | None = None, rebalance: bool = False) -> str:
    """Persist the cleaned table: parquet partitioned by year (prunable), or CSV with
    header and all columns (never partitioned: folders would take a column out of
    the files). A task writes into the folders of all years it meets, so whole rows are not
    shuffled for it; ``rebalance`` shuffles them by the partition column first, for columns of
    many values, so that a task writes few folders.

    ``touched_only`` replaces the folders of the years in ``df`` and leaves all others as they are, so that a
    run over some years can be repeated; the new files are moved in when the whole job has succeeded.
    ``sort_by`` orders the rows inside each file, so that filters on these columns skip row groups by their
    least and greatest values.
    """
    if fmt == "csv":
        df.write.mode("overwrite").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return path
    if touched_only and not partition_by:
        raise ValueError("touched_only needs a partition column")
    if partition_by and rebalance:
        df = df.hint("rebalance", partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic" if touched_only else "static")
    w.parquet(path)
    return path


def write_report(tables: dict, path: str, parallel: int = 4) -> dict[str, str]:
    """Write each report table (insights, summary, discount impact...) as parquet.

    Values are DataFrames or zero-argument functions returning one. Their jobs are
    submitted from ``parallel`` threads at once: Spark runs concurrent jobs of
    one application side by side, so short jobs do not leave executors idle.
    The number of files follows the size of the result (adaptive execution
    coalesces small partitions); nothing is forced through one task.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        name, df = item
        if callable(df):            # a builder: construct the plan in this thread
            df = df()
        p = f"{path}/{name}"
        df.write.mode("overwrite").parquet(p)
        return name, p

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return dict(pool.map(one, tables.items()))


def checkpoint_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to a new folder under the shared checkpoint
    folder and read it back: lineage is cut (a lost executor re-reads files),
    later counts come from parquet metadata, and readers keep column pruning."""
    from ledgerlens.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
