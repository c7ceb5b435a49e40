"""Session helpers: builder defaults and a shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Of the files read, for a shuffle partition. A task of the star join sorts its share in memory, where it takes some forty times that.
PARTITION_BYTES = 16 << 20
_SIZING = threading.RLock()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """A session with the settings every operator assumes.

    UTC session time zone (dates are compared with an external oracle), ANSI on,
    adaptive execution with partition coalescing and skew-join splitting.
    On a cluster pass ``shuffle_partitions`` sized to the input
    (~128-256 MB of shuffle data per partition).
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ansi.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder and
    is used as is. When nothing is configured, a single-machine master
    (``local``, ``local[N]``) gets a fresh folder under the system temp
    directory; any other master raises, because executors would each write to
    a disk that the others cannot read.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder path below the checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "ledgerlens-tables", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application wrote under ``scratch_path``. For the end
    of an application: DataFrames that read them cannot be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(ensure_checkpoint_dir(spark), "ledgerlens-tables"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads (0 for rows that come from no file)."""
    spark = df.sparkSession
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


@contextmanager
def sized_shuffles(df: DataFrame) -> Iterator[None]:
    """For writing ``df``: a shuffle partition for every ``PARTITION_BYTES`` of the files it reads, and never fewer
    than are set, so that a task needs no more memory when the input grows. Adaptive execution joins small ones.

    One such write at a time, as the setting is the session's; queries planned meanwhile have more partitions too.
    """
    spark, name = df.sparkSession, "spark.sql.shuffle.partitions"
    with _SIZING:
        before = spark.conf.get(name)
        spark.conf.set(name, str(max(int(before), -(-file_bytes(df) // PARTITION_BYTES))))
        try:
            yield
        finally:
            spark.conf.set(name, before)
