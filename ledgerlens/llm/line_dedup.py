"""Line de-duplication over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends and with
A-Z lower-cased; keys shorter than ``min_chars`` code points are never touched.
``LineRuns`` keeps what was seen as sorted runs ``(key, n_docs, max_doc,
first_batch)`` in levels: each batch merge-anti-joins the runs (its lines that
no run knows are novel), adds its own sorted run, and ``fanout`` runs of a level
are compacted into one run of the next. ``drop_common_lines`` removes the lines
found in at least ``min_docs`` documents, except in the largest id holding one.

Defined cases: a null or empty text is one empty line; a text is split at every
line feed, so ends of text give empty lines; repeated rows of one id count as
one document; rows without an id count as no document and lose every common
line; an empty table gives an empty result; other columns pass through
``drop_common_lines`` untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, strip_space, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 2


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(strip_space(line))


def key_hash(key: Column) -> Column:
    """128 bits, so that unequal lines of any corpus do not meet."""
    return F.unhex(F.md5(key))


class LineRuns:
    """Levelled runs of line hashes; ``add`` takes one batch of ``(key, doc_id)`` rows."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.batches = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, entries: DataFrame) -> DataFrame:
        """Add a batch; returns its run, in which ``first_batch`` marks the novel keys."""
        batch = entries.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"),
                                           F.max("doc_id").alias("max_doc"))
        novel = reduce(lambda left, run: left.join(run.select("key").hint("merge"), "key", "left_anti"),
                       self.runs(), batch) if self.runs() else batch
        own = batch.withColumn("first_batch", F.lit(self.batches)) if not self.runs() else (
            batch.join(novel.select("key", F.lit(self.batches).alias("first_batch")), "key", "left"))
        run = written(own.sort("key"), "line-run")
        self.batches += 1
        self._push(0, run)
        return run

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = written(self.merge(self.levels[level]).sort("key"), f"line-level{level + 1}")
            self.levels[level] = []
            self._push(level + 1, merged)

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        """One row per key; batches hold different documents, so counts add up."""
        return (reduce(DataFrame.unionByName, runs).groupBy("key")
                .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"),
                     F.min("first_batch").alias("first_batch")))

    def table(self) -> DataFrame:
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self.merge(runs)


def line_entries(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(key, doc_id)`` of every distinct long line of every row."""
    keys = F.filter(F.transform(split_lines(F.col(text_col)), line_key),
                    lambda k: F.length(k) >= min_chars)
    return docs.select(F.explode(F.array_distinct(keys)).alias("line"), F.col(id_col).alias("doc_id")).select(
        key_hash(F.col("line")).alias("key"), "doc_id")


def build_runs(entries: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """Feed ``entries`` to the runs in ``batches`` groups of documents (by hash of the id)."""
    index = LineRuns(fanout)
    for b in range(batches):
        index.add(entries.where(F.col("batch") == b).drop("batch"))
    return index


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the common lines taken out of ``text_col``, plus a struct ``__lines`` of
    ``n_lines`` (before) and ``n_dropped``. Hot lines meet only as counts; the
    join that hands them back is on narrow rows and can be split by AQE."""
    entries = line_entries(docs, min_chars, id_col, text_col)
    entries = written(entries.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")),
                      "line-entries", "batch")
    common = build_runs(entries, batches).table().where(F.col("n_docs") >= min_docs).select("key", "max_doc")
    drops = (entries.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
             .groupBy("doc_id").agg(F.collect_set("key").alias("drops"))
             .select(F.struct("doc_id", "drops").alias("__drop")))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["__drop"]["doc_id"]), "left")
    lines, gone = split_lines(F.col(text_col)), F.col("__drop.drops")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(gone, key_hash(key))

    kept = F.when(gone.isNull(), lines).otherwise(F.filter(lines, stays))
    joined = joined.withColumn("__kept", kept)
    out = [F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n")).alias(c)
           if c == text_col else docs[c] for c in docs.columns]
    n = F.size(split_lines(F.col(text_col)))
    return joined.select(*out, F.struct(n.cast("long").alias("n_lines"),
                                        (n - F.size("__kept")).cast("long").alias("n_dropped")).alias("__lines"))
