"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Quality classifier, line de-duplication, near duplicates, benchmark
decontamination, packing. Every stage works on all rows that the one before it
kept and hands on the columns of ``documents``; the last returns the packed
pieces. Extra columns of ``documents`` are left out at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, line_dedup, near_dup, packing, quality_net, tokens
from ledgerlens.llm.common import majority_labels, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated probability of being good is at least 0.3; learnt from all labels."""
    docs = docs.select(*[c for c in COLUMNS if c in docs.columns])
    model = quality_net.train(docs, majority_labels(table(spark, sf_dir, "labels"), "quality"))
    return quality_net.scored(docs, model, "__score").where(F.col("__score") >= quality_net.ACCEPT).drop("__score")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least five documents stay only in the largest id; ``n_chars`` follows the text."""
    out = line_dedup.drop_common_lines(docs)
    changed = F.col("__lines.n_dropped") > 0
    return out.select(*[F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                        if c == "n_chars" else F.col(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest id, rows without an id last (five-word shingles,
    similarity 0.8).

    Every row has a number of its own, its place in the files read, and is judged by it: of repeated
    rows one stays, of an id with several texts each text is judged apart, and rows without an id are
    rows like any others. Texts without words are in no group and all stay.
    """
    rows = docs if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" else written(docs, "near-rows")
    rows = rows.withColumn("__row", F.struct(F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.row_index").alias("place")))
    ordered = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__row").alias("row"))
    kept = near_dup.near_duplicates(rows.select(ordered.alias("doc_id"), "text"), words=5, percent=80)
    kept = kept.where("kept").select(F.col("doc_id.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item's question and answer, or near copies of them, go."""
    found = decontam.with_matches(docs, table(spark, sf_dir, "benchmark"), name="__items",
                                  part_overlap=decontam.PART_OVERLAP)
    return found.where(F.size("__items") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.default_path(), capacity=2048)


STAGES = [("quality_classifier", good_quality), ("line_dedup", without_common_lines),
          ("minhash_near_dedup", without_near_duplicates), ("benchmark_decontamination", without_benchmark),
          ("best_fit_packing", packed)]

#: The stages learn, hash and tokenise; SQL cannot express them. Tests hold each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
