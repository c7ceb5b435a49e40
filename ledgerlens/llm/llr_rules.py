"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``buckets``. Over all documents a raw-corpus
multinomial is counted, over all trusted documents a target multinomial; a
document's score is the mean over its n-grams of log p(target) - log p(raw). It is
kept if the base rules pass and its score is at least ``threshold``, the same
rule for every document, at every size of the corpus.

Only built-in expressions. The table of ratios has ``buckets`` numbers by
construction; a document's hashes are looked up in it by position.

Defined cases: null and empty texts have no words and fail the base rules; a text
with words but no trusted corpus scores 0; repeated rows count each in the raw
corpus and, if labelled trusted, in the target; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

BUCKETS = 1 << 14
THRESHOLD = -0.11
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
_PLACE_BITS = 24


def words_of(text: Column) -> Column:
    """White-space separated words; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\t-\r]+", -1))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``hashes`` (of the words) and the base counts; one column a step, so that
    no array is built twice.

    Repeated three-word windows: each window becomes one number, the upper bits of
    its hash above its place; sorted, equal windows are neighbours, which their full
    hashes confirm. The places of repeated windows, in order, then count
    min(3, distance to the one before) words each. Linear space, one sort a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lit((1 << _PLACE_BITS) - 1)
    none = F.array().cast("array<long>")

    out = docs.withColumn("words", words_of(F.col(text_col)))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    three = F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    out = out.withColumn("windows", three)
    packed = F.transform("windows", lambda x, i: x.bitwiseAND(F.bitwise_not(low.cast("long"))).bitwiseOR(i.cast("long")))
    out = out.withColumn("packed", packed)
    out = out.withColumn("sorted", F.sort_array(F.slice("packed", F.lit(1), F.greatest(F.size("packed") - 2, F.lit(0)))))

    def place(x: Column) -> Column:
        return x.bitwiseAND(low.cast("long")).cast("int")

    def equal(x: Column, y: Column) -> Column:
        return ((F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS))
                & (F.get("windows", place(x)) == F.get("windows", place(y))))

    out = out.withColumn("again", F.filter("sorted", lambda x, i: equal(x, F.get("sorted", i + 1))
                                           | equal(x, F.get("sorted", i - 1))))
    out = out.withColumn("places", F.when(F.size("again") == 0, none).otherwise(
        F.sort_array(F.transform("again", lambda x: x.bitwiseAND(low.cast("long"))))))
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
                          lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"),
                                                p.alias("last")), lambda s: s["n"])
    return out.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(two) - 1, F.lit(0))))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios``, array by bucket; ``trusted`` (label_id) are the target's documents.
    Counts are partial sums by bucket, so no word, however frequent, gathers rows. The trusted
    ids grow with the documents, so both sides are merged at every size, never broadcast."""
    ids = trusted.select("label_id").distinct().hint("merge")
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("label_id"), "left")
    hashed = marked.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
                           F.col("label_id").isNotNull().cast("long").alias("target"))
    grams = hashed.select(F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"), "target")
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "llr-counts")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = rows.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"),
                     F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    smooth = F.lit(float(buckets))
    ratio = F.when(F.col("target") == 0, F.transform("t", lambda x: F.lit(0.0))).otherwise(F.transform(
        "t", lambda x: F.log((x["target"] + 1) / (F.col("target") + smooth)) - F.log((x["raw"] + 1) / (F.col("raw") + smooth))))
    return written(table.select(ratio.alias("ratios")), "llr-ratios")


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base counts, base_failed, llr, kept."""
    ratios = log_ratios(docs, trusted, buckets).first()["ratios"]             # ``buckets`` numbers
    looked_up = F.lit(ratios) if ratios else F.array().cast("array<double>")
    out = base_counts(docs.select("doc_id", "text")).withColumn("grams", ngram_buckets(F.col("hashes"), buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(looked_up, b))
    llr = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("llr", llr)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")
