"""The registered queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, divergence, length_hist, line_dedup, llr_rules, near_dup, packing, period_runs, quality_net,
               secret_scan, suffix_dedup, tokens, url_reputation, warc)
from .common import majority_labels, table

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_reputation.page_labels(table(spark, sf_dir, "labels"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = majority_labels(table(spark, sf_dir, "labels"), "quality")
    model = quality_net.train(docs, labels.where(~quality_net.held_out(F.col("label_id"))))
    return quality_net.scored(docs, model).select(
        "doc_id", quality_net.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_net.ACCEPT).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), capacity=2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    clean = majority_labels(labels, "toxic").where("label = 0").select("label_id")
    trusted = majority_labels(labels, "quality").where("label = 1").join(clean, "label_id")
    return llr_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(rank: int):
        return F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secret_scan.rendered(F.col("base_spans")), 256).alias("base_sha256"),
                        secret_scan.rendered(F.col("all_spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs).select(
        "doc_id", "__lines.n_lines", "__lines.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_matches(docs, table(spark, sf_dir, "benchmark"), name="found",
                                  part_overlap=decontam.PART_OVERLAP)
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"),
                        F.sort_array("found.item_id").alias("item_ids"), F.get("found.score", 0).alias("best_score"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_hist.length_histogram(table(spark, sf_dir, "documents"), tokens.default_path())
    return length_hist.with_sums(histogram)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, words=4, percent=80)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth id (by checksum) the words from some place on repeat with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + np.arange(n - first) % period
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)
    best = period_runs.longest_run()
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (
    op1_url_filters, op2_quality_classifier, op3_best_fit_packing, op4_quality_rules, op5_secret_scans, op6_warc,
    op7_line_dedup, op8_benchmark_decontamination, op9_token_counts, op10_minhash_near_dedup,
    op11_periodic_runs, op12_suffix_dedup, op13_source_divergence)}
