"""Loading raw CSV exports whose lines do not all have as many fields as the header.

One line in a billion with a stray delimiter must not end the read. Every line gets
a fate:

* ``whole``: as many fields as the header has;
* ``short``: fewer; the missing ones at the end are null, and the row is loaded
  (as a pandas reader does);
* ``surplus``: more; which field is the stray one cannot be told, so the line is not
  loaded but kept, with its text, its file and its number of fields, in a side table;
* ``unreadable``: the parser refused the line although its fields fit the header
  (broken quoting); kept in the side table too.

The text is parsed once: rows and side table are written by one job, in one folder
per fate, and what reads them later reads columns of Parquet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.constants import NULL_TOKENS
from ledgerlens.session import scratch_path
from ledgerlens.sources.files import csv_dialect, header_names

FATES = ("whole", "short", "surplus", "unreadable")
LOADED = ("whole", "short")


class SalesLoad(NamedTuple):
    """``rows``: all-string rows under the header's names, null tokens as nulls.
    ``bad_rows``: file, fields, expected, line. ``counts``: fate, lines (one row per fate)."""
    rows: DataFrame
    bad_rows: DataFrame
    counts: DataFrame


def field_count(line: Column) -> Column:
    """Fields of a CSV line: delimiters outside quoted fields, plus one."""
    bare = F.regexp_replace(line, '(^|,)"(?:[^"]|"")*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it, whatever its case."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def parsed_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(row, fate, file, line, fields): every line of the files; ``line`` only where the row is not loaded."""
    names = header_names(spark, path)
    line = free_name(names, "_line")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, line]])
    df = spark.read.schema(schema).options(
        header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=line, multiLine=multi_line,
        columnPruning=False, **csv_dialect()).csv(path)
    text, n = F.col(f"`{line}`"), len(names)
    fields = F.when(text.isNotNull(), field_count(text))
    fate = (F.when(text.isNull(), "whole").when(fields < n, "short").when(fields > n, "surplus").otherwise("unreadable"))
    row = F.struct(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in names])
    out = df.select(row.alias("row"), fate.alias("fate"), F.input_file_name().alias("file"), text.alias("line"),
                    fields.alias("fields"))
    loaded = F.col("fate").isin(*LOADED)
    return out.select(F.when(loaded, F.col("row")).alias("row"), "fate", F.when(~loaded, F.col("file")).alias("file"),
                      F.when(~loaded, F.col("line")).alias("line"), "fields")


def load_sales(spark: SparkSession, path: str, out: str | None = None, multi_line: bool = False) -> SalesLoad:
    """Load a CSV export with a header (the same in every file) into ``out`` (a new scratch folder if not given).

    ``multi_line`` allows line breaks inside quoted fields; such files cannot be split, so each is read by one task.
    """
    out = out or scratch_path(spark, "sales-load")
    lines = parsed_lines(spark, path, multi_line)
    lines.write.mode("overwrite").option("compression", "zstd").partitionBy("fate").parquet(out)
    back = spark.read.schema(lines.schema).parquet(out)
    expected = len(lines.schema["row"].dataType)
    bad = back.where(~F.col("fate").isin(*LOADED)).select("file", "fields", F.lit(expected).alias("expected"), "line")
    every = spark.createDataFrame([(i, f) for i, f in enumerate(FATES)], "no int, fate string")
    found = back.groupBy("fate").agg(F.count(F.lit(1)).alias("lines"))
    counts = (every.join(F.broadcast(found), "fate", "left").orderBy("no")          # one row per fate
              .select("fate", F.coalesce("lines", F.lit(0).cast("long")).alias("lines")))
    return SalesLoad(back.where(F.col("fate").isin(*LOADED)).select("row.*"), bad, counts)


def load_audit(load: SalesLoad) -> DataFrame:
    """The loading steps in the columns of ``clean.cleaning_audit``: lines that became rows, and short rows filled."""
    n = {f: F.sum(F.when(F.col("fate") == f, F.col("lines"))) for f in FATES}
    total = F.sum("lines")
    steps = F.array(*[F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"), before.alias("rows_before"),
                               after.alias("rows_after"), (before - after).alias("rows_dropped"))
                      for no, name, before, after in ((-1, "load_sales", total, n["whole"] + n["short"]),
                                                      (0, "fill_short_rows", n["short"], n["short"]))])
    return load.counts.agg(steps.alias("s")).select(F.explode("s").alias("s")).select("s.*")
