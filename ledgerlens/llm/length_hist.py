"""Token counts by an exact length histogram.

Documents are encoded once and aggregated by encoded length; all further answers
come from the histogram, whose size is bounded by the longest document, not by
the number of documents. For every length ``L`` that occurs, taken as a context
limit: documents and tokens up to it, documents and tokens beyond it (suffix
sums), tokens kept when every document is cut at ``L``, and the share of
documents not longer than ``L``. ``quantiles`` reads any quantile of the length.

Suffix sums go block by block of lengths, so no task sees the whole histogram.

Defined cases: null and empty texts have length 0 and count as documents;
repeated rows count each; an empty table gives an empty histogram; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .text_kernels import give_back
from .tokens import encoder, slices

BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(length) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(part["text"]), pa.int64())], ["length"])
        give_back()

    return docs.select("text").mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(length, n_docs), written once."""
    return written(encoded_lengths(docs, tokenizer_path).groupBy("length").agg(F.count("*").alias("n_docs")),
                   "length-histogram")


def with_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with prefix and suffix sums at every length."""
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"),
                            F.floor(F.col("length") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)      # one row per block
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
                           F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
                           F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "*", (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("tokens_after") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("tokens_over"))
    return out.select(
        "length", "n_docs", "n_tokens", "docs_over", "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any context limits, whether or not a document has that length:
    (context_limit, docs_within, docs_over, tokens_kept, tokens_total)."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    within = F.col("length") <= F.col("context_limit")
    longer = F.when(~within, F.col("n_docs")).otherwise(0)
    kept = F.when(within, F.col("n_tokens")).otherwise(F.col("context_limit") * F.col("n_docs"))
    pairs = sums.select("length", "n_docs", "n_tokens", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in
                                                                            sorted(set(limits))])).alias("context_limit"))
    sums_ = pairs.groupBy("context_limit").agg(
        F.sum(F.col("n_docs") - longer).alias("docs_within"), F.sum(longer).alias("docs_over"),
        F.sum(kept).alias("tokens_kept"), F.sum("n_tokens").alias("tokens_total"))
    return asked.join(sums_, "context_limit", "left").na.fill(0)


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents does not exceed."""
    pairs = sums.select("length", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return pairs.where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))
