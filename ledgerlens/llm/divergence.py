"""Audit of how far the sources of a language diverge, by three-dimensional cube partitioning.

A group is a (lang, source). Every language keeps the terms found in at least
``min_docs`` of its documents; a group gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, in whole numbers. Two
groups of a language diverge by the sum of ``|p - q|`` over all kept terms; a
group diverges from its language term by term.

Sums over pairs are computed in a cube. Groups fall into group blocks, kept terms
into term blocks, and a task owns one cell (group block, group block, term
block). The slice (group, term block), at most a block of terms as a list of the
counted ones, is replicated to the cells of its group block, one for each group
block; a cell fills two small dense matrices, adds up its pairs, and the partial
sums are reduced along the term axis. Cells have a bounded size whatever the
input, their number grows with it, and no task sees all terms or all groups.

Words are counted inside the tasks that read the texts, so a source with a third
of all documents, or a word in all of them, sends as many rows as the others.

Defined cases: null text, lang and source count as the empty string; texts without
terms count as documents of their group; a language without kept terms has ``V = 0``
and pairs of value 0; repeated rows are documents of their own; equal values are
ranked by item; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .text_kernels import give_back

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
GROUP_BLOCK = 8
TERM_BLOCK = 4096
HELD_TERMS = 400_000

#: Letters and everything beyond ASCII are kept, A-Z folded; all other bytes become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up inside the reading tasks
    over stretches of documents with some ``held`` terms; a key may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in counts.items():
                terms, n = list(c), len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64()),
                     pa.array([seen[lang, source][t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for row, group in enumerate(zip(batch["lang"].to_pylist(), batch["source"].to_pylist())):
                words = Counter(texts[row].as_py().translate(_FOLD).split())
                own = counts[group]
                size -= len(own)
                own.update(words)
                seen[group].update(words.keys())
                size += len(own)
                if size >= held:
                    yield from out()
                    counts.clear()
                    seen.clear()
                    size = 0
        yield from out()
        counts.clear()
        seen.clear()
        give_back()

    return docs.select("lang", "source", "text").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share ``p``, exact; null where nothing is kept."""
    whole = (n + PRIOR * v).cast("decimal(20,0)")
    part = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(whole > 0, 1 + F.call_function("div", part, whole))


class Groups:
    """The written tables of one audit."""

    def __init__(self, docs: DataFrame, min_docs: int, group_block: int, term_block: int):
        named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                              for c in ("text", "lang", "source")])
        by_term = Window.partitionBy("lang", "term")
        counted = (term_counts(named).repartition("lang", "term").groupBy("lang", "term", "source")
                   .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        #: (lang, term, source, n, lang_n, once) of the kept terms; ``once`` marks one row per term
        self.kept = written(
            counted.select("lang", "term", "source", "n", F.sum("n").over(by_term).alias("lang_n"),
                           F.sum("docs").over(by_term).alias("df"),
                           (F.min("source").over(by_term) == F.col("source")).alias("once"))
            .where(F.col("df") >= min_docs).drop("df"), "divergence-kept")
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = self.kept.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                              F.count(F.when(F.col("once"), 1)).alias("v"))
        groups = named.select("lang", "source").distinct()
        sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
        zero = F.lit(0).cast("long")
        #: (lang, source, total, lang_total, v, group_block, group_blocks, term_blocks), one row per group
        self.groups = written(
            groups.join(sizes, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
                "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "v")],
                F.ceil(F.col("n_groups") / group_block).cast("int").alias("group_blocks"))
            .withColumn("group_block", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int"))
            .withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).cast("int")),
            "divergence-groups")

    def terms(self) -> DataFrame:
        """(lang, term, term_block, place): every kept term's place in its block."""
        blocks = self.groups.groupBy("lang").agg(F.max("term_blocks").alias("term_blocks"))
        placed = self.kept.where("once").select("lang", "term").join(blocks, "lang").select(
            "lang", "term", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("term_block"))
        order = Window.partitionBy("lang", "term_block").orderBy("term")
        return written(placed.withColumn("place", F.row_number().over(order) - 1), "divergence-terms")

    def slices(self) -> DataFrame:
        """One row per (group, term block): shares of the counted terms by place, ``p0`` of all others."""
        terms = self.terms()
        widths = terms.groupBy("lang", "term_block").agg(F.count("*").cast("int").alias("width"))
        counted = (self.kept.join(terms, ["lang", "term"])
                   .join(self.groups.select("lang", "source", "total", "v"), ["lang", "source"])
                   .groupBy("lang", "source", "term_block")
                   .agg(F.collect_list(F.struct("place", share(F.col("n"), F.col("total"), F.col("v")).alias("p")))
                        .alias("own")))
        every = self.groups.select("lang", "source", "group_block", "group_blocks",
                                   share(F.lit(0), F.col("total"), F.col("v")).alias("p0"),
                                   F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
        return (every.join(widths, ["lang", "term_block"], "left")
                .join(counted, ["lang", "source", "term_block"], "left")
                .select("lang", "source", "group_block", "group_blocks", "term_block",
                        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("p0", F.lit(0)).alias("p0"),
                        F.col("own.place").alias("places"), F.col("own.p").alias("shares")))


def _matrix(rows: pa.Table) -> np.ndarray:
    """A row of shares for each group of a slice, a column for each term of the block."""
    width = rows["width"][0].as_py() if len(rows) else 0
    out = np.repeat(rows["p0"].to_numpy()[:, None], width, axis=1)
    for line, places, shares in zip(out, rows["places"], rows["shares"]):
        if places.is_valid:
            line[places.values.to_numpy()] = shares.values.to_numpy()
    return out


def cell(rows: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell over its block of terms."""
    rows = rows.sort_by("source")
    blocks = rows["group_block"].to_numpy()
    a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
    left, right = rows.filter(pa.array(blocks == a)), rows.filter(pa.array(blocks == b))
    own, other = _matrix(left), _matrix(right)
    names, others = left["source"].to_pylist(), right["source"].to_pylist()
    found: tuple[list, list, list] = [], [], []
    for i, name in enumerate(names):
        first = i + 1 if a == b else 0                           # every pair of a block once
        if first >= len(others):
            break
        part = np.abs(other[first:] - own[i]).sum(axis=1, dtype=np.int64)
        for column, values in zip(found, ([name] * len(part), others[first:], part.tolist())):
            column += values
    return pa.table([pa.array([rows["lang"][0].as_py()] * len(found[0]), pa.string()), pa.array(found[0], pa.string()),
                     pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())],
                    names=["lang", "left", "right", "part_value"])


def pair_divergences(groups: Groups) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    cells = (groups.slices()
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
             .withColumn("a", F.least("group_block", "other")).withColumn("b", F.greatest("group_block", "other"))
             .groupBy("lang", "a", "b", "term_block")
             .applyInArrow(cell, "lang string, `left` string, `right` string, part_value long"))
    sums = written(cells.groupBy("lang", "left", "right").agg(F.sum("part_value").alias("value")), "divergence-pairs")
    return sums.select("lang", F.col("left").alias("source"), F.col("right").alias("item"), "value").union(
        sums.select("lang", "right", "left", "value"))


def term_divergences(groups: Groups) -> DataFrame:
    """(lang, source, item, value) for every kept term that a group has and uses more than its language does."""
    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return (groups.kept.join(groups.groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
            .where(p > q).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
          term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; terms up to rank ``top_terms``."""
    groups = Groups(docs, min_docs, group_block, term_block)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(groups).withColumn("rank", F.row_number().over(order))
    terms = term_divergences(groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    named = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
             for part, df in (("pair", pairs), ("term", terms))]
    return named[0].union(named[1])
