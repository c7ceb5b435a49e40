"""Write a derived table once per session and read it back.

Many reports run over the same derived table (e.g. ``sales``, a six-table
join). Writing it as parquet under the shared checkpoint folder cuts the
lineage (a lost executor re-reads files instead of re-running the joins) and
keeps parquet column pruning and filter pushdown for every report reading it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import scratch_path, sized_shuffles

T = TypeVar("T")

_WRITTEN: dict[tuple, tuple] = {}
_LOCK = threading.RLock()


def fingerprint(spark: SparkSession, source: str) -> int:
    """Names, sizes and times of the files under ``source`` (two levels), so that
    a table written from files that changed meanwhile is not used again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []

    def look(p, depth):
        for f in fs.listStatus(p):
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
            if f.isDirectory() and depth:
                look(f.getPath(), depth - 1)

    if fs.exists(path):
        look(path, 1)
    return hash(tuple(sorted(seen)))


def kept_once(spark: SparkSession, name: str, source: str, make: Callable[[], T]) -> T:
    """What ``make()`` returned, made once per application, name and state of the source files."""
    key = (spark.sparkContext.applicationId, name, source)
    state = fingerprint(spark, source)
    with _LOCK:
        value, old = _WRITTEN.get(key, (None, None))
        if value is None or old != state:
            value = make()
            _WRITTEN[key] = value, state
    return value


def written_once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """A folder that ``write(path)`` filled, once per application, name and state of the source files."""
    def make() -> str:
        path = scratch_path(spark, name)
        write(path)
        return path

    return kept_once(spark, name, source, make)


def materialized(spark: SparkSession, name: str, source: str,
                 build: Callable[[SparkSession, str], DataFrame],
                 partition_by: str | None = None, rebalance: bool = True) -> DataFrame:
    """``build(spark, source)`` written once per application, table name and state
    of the source files, optionally partitioned by a column (filters on it then skip whole folders).
    Without ``rebalance`` a task writes into the folders of all values it meets: no shuffle of whole
    rows, for columns of few values. Compressed with zstd, as such tables are large and read often.
    The joins and sorts that build it have shuffle partitions for the size of their input."""
    def write(path: str) -> None:
        df = build(spark, source)
        if partition_by and rebalance:
            df = df.hint("rebalance", partition_by)
        w = df.write.mode("overwrite").option("compression", "zstd")
        with sized_shuffles(df):
            (w.partitionBy(partition_by) if partition_by else w).parquet(path)

    return spark.read.parquet(written_once(spark, name, source, write))


def materialized_path(spark: SparkSession, name: str, source: str) -> str | None:
    """Folder of a table written by ``materialized`` in this application."""
    return _WRITTEN.get((spark.sparkContext.applicationId, name, source), (None, None))[0]
