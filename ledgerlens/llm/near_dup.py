"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is its set of word shingles; equal sets become one representative
(so thousands of copies cost one row). The ``k`` smallest hashes of a set are its
sketch. Two sets of Jaccard similarity ``percent`` or more share at least
``floor_shared`` of the ``k`` retained values (but for a chance
of 1e-5 at most, see ``shared_floor``), which gives three steps:

1. inverted lists of the retained values: a representative of which too few
   values occur in any other sketch has no partner; of the others the full sets
   are read, and those of which too few shingles occur in any other set go too;
2. lists over the values that a pair must meet in: each sketch in ascending
   document frequency, cut so that two sketches with ``floor_shared`` common
   values share one of those left. Frequent passages so drop out of the lists
   of documents that hold more than the passage;
3. candidates from the lists: a pair is taken in the list of its smallest common
   value only, must pass the bounds and the estimate from the sketch of the
   union, and is verified on full sets. First a few pivots of each list are
   compared with its members; what that joins into components need not be
   compared again. Last, in every list that still holds several components,
   every member outside the largest one is compared with all members of other
   components, so no link is lost; there the full sets go into the join, which
   hands on verified links only.

Large lists are never gathered in one task: pivots are partial minima and lists
meet in joins that AQE splits.

Defined cases: null or empty texts and texts of white space have no shingles and
are linked with nothing; ties do not occur, sets are equal or not; repeated rows
are copies like any others; rows without an id take part, and a component takes
the smallest id there is; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components
from .text_kernels import give_back, shingle_sets

K = 32
MISS = 1e-5
PIVOTS = 4
PIVOT_ROUNDS = 2


def shared_floor(k: int, percent: int, miss: float = MISS) -> int:
    """Retained values that two sketches of ``k`` share at least, but for a chance of ``miss``
    (binomial: each of the union's ``k`` smallest lies in both sets with the similarity's chance)."""
    p, below = percent / 100, 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * p**shared * (1 - p) ** (k - shared)
        if below > miss:
            return shared
    return k


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _node(values: np.ndarray) -> bytes | None:
    return hashlib.md5(values.tobytes()).digest() if len(values) else None


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, print, node, n, sketch) per row; ``node`` names the set, null without shingles, ``print`` the text."""
    fields = [docs.schema["doc_id"], T.StructField("print", T.LongType()), T.StructField("node", T.BinaryType()),
              T.StructField("n", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, low = [], [], []
            for values in shingle_sets(batch["text"].to_pylist(), words):
                nodes.append(_node(values))
                sizes.append(len(values))
                low.append(values[:k].copy())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["print"], pa.array(nodes, pa.binary()),
                                              pa.array(sizes, pa.int32()), _lists(low)],
                                             ["doc_id", "print", "node", "n", "sketch"])
        give_back()

    return docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(run, T.StructType(fields))


def text_print() -> Column:
    """Beside the id it tells rows without an id, or with the same one, apart when texts are looked up."""
    return F.xxhash64("text")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rid, n, values) of the wanted representatives (rid, doc_id, print, node), read from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, sets = [], []
            for rid, node, values in zip(batch["rid"].to_pylist(), batch["node"].to_pylist(),
                                         shingle_sets(batch["text"].to_pylist(), words)):
                if _node(values) == node:          # another row may carry the same id
                    rids.append(rid)
                    sets.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                                              _lists(sets)], ["rid", "n", "values"])
        give_back()

    ids = wanted.select("rid", "node", F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
    own = docs.select("doc_id", "text", text_print().alias("print"))
    rows = own.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print"))).select(
        "rid", "node", "text")
    sets = written(rows.mapInArrow(run, "rid long, n int, values array<long>"), "near-sets")
    if sets.groupBy("rid").count().where("count > 1").isEmpty():
        return sets
    return written(sets.dropDuplicates(["rid"]), "near-sets-once")       # the same row twice in the table


def least_shared(size: Column, percent: int, floor_shared: int) -> Column:
    """Retained values that a sketch of ``size`` must share with any partner's sketch."""
    return F.least(F.lit(floor_shared), F.ceil(size * percent / 100)).cast("int")


def _private(values: DataFrame) -> DataFrame:
    """(rid, private): per representative, how many of its values no other one has."""
    return (values.groupBy("value").agg(F.count("*").alias("c"), F.min("rid").alias("rid")).where("c = 1")
            .groupBy("rid").agg(F.count("*").alias("private")))


def survivors(docs: DataFrame, reps: DataFrame, words: int, percent: int, floor_shared: int) -> DataFrame:
    """(rid, n, shared, values) of the representatives that can have a partner, by step 1;
    ``shared`` counts the values that some other candidate has too."""
    private = _private(reps.select("rid", F.explode("sketch").alias("value")))
    kept = F.size("sketch") - F.coalesce("private", F.lit(0))
    first = reps.join(private, "rid", "left").where(kept >= least_shared(F.size("sketch"), percent, floor_shared))
    sets = full_sets(docs, first.select("rid", "doc_id", "print", "node"), words)
    private = _private(sets.select("rid", F.explode("values").alias("value")))
    left = sets.join(private, "rid", "left").withColumn("shared", F.col("n") - F.coalesce("private", F.lit(0)))
    return written(left.where(100 * F.col("shared") >= percent * F.col("n")).select("rid", "n", "shared", "values"),
                   "near-survivors")


def postings(sets: DataFrame, k: int, percent: int, floor_shared: int) -> DataFrame:
    """(value, rid, n, shared, central, pre, sketch): the inverted lists of step 2. ``pre`` are a sketch's
    listed values, ``central`` adds up how many sketches its values are in."""
    rows = sets.select("rid", F.explode(F.slice("values", 1, k)).alias("value"))
    shared = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(shared, "value").groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))          # k values at most
    size = F.least(F.col("n"), F.lit(k))
    length = size - least_shared(size, percent, floor_shared) + 1 - (size - F.size("own"))
    pre = F.when(length > 0, F.slice("own.value", F.lit(1), F.greatest(length, F.lit(1))))
    central = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    out = (sets.join(ordered, "rid").select("rid", "n", "shared", central.alias("central"),
                                            F.slice("values", 1, k).alias("sketch"), pre.alias("pre"))
           .where(F.col("pre").isNotNull()))
    return out.select(F.explode("pre").alias("value"), "rid", "n", "shared", "central", "pre", "sketch")


def _similar(k: int, percent: int, floor_shared: int) -> Column:
    """Of a pair (a, b) met in list ``value``: right list, bounds, union-sketch estimate. What both
    share is at most what either shares with anyone, which bounds the similarity from above."""
    na, nb = F.col("a.n"), F.col("b.n")
    most = F.least("a.shared", "b.shared")
    union = F.slice(F.sort_array(F.array_union("a.sketch", "b.sketch")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("a.sketch", "b.sketch")))
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (na + nb - most))
            & (F.array_min(F.array_intersect("a.pre", "b.pre")) == F.col("a.value"))
            & (shared >= least_shared(F.size(union), percent, floor_shared)))


def candidates(lists: DataFrame, similar: Column, pivots: int | None) -> DataFrame:
    """(a, b) pairs across components; ``lists`` are postings with ``comp``. With ``pivots`` only
    as many members of each list ask, those in the middle of their groups; without, all members
    outside the list's largest component, and ``lists`` may have further columns for ``similar``."""
    live = (lists.groupBy("value", "comp").agg(F.count("*").alias("c")).groupBy("value")
            .agg(F.max(F.struct("c", "comp")).alias("big"), F.count("*").alias("comps"))
            .where("comps > 1").select("value", F.col("big.comp").alias("big")))
    asks = lists.join(live, "value").where("comp <> big")
    if pivots:
        row = F.struct("central", F.xxhash64("rid").alias("h"), "rid", "n", "shared", "comp", "pre", "sketch", "big")
        asks = asks.groupBy("value", F.pmod(F.xxhash64("rid"), F.lit(pivots)).alias("slot")).agg(
            F.max(row).alias("p")).select("value", "p.*")
    cross = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("a.big")) | (F.col("a.rid") < F.col("b.rid"))
                                                    | F.lit(bool(pivots)))
    met = asks.alias("a").join(lists.alias("b"), (F.col("a.value") == F.col("b.value")) & cross & similar)
    return met.select(F.least("a.rid", "b.rid").alias("a"), F.greatest("a.rid", "b.rid").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("values").alias("va"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb"))
    inter = F.size(F.array_intersect("va", "vb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def unsettled(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists that hold several components, with their members' full sets."""
    open_ = lists.groupBy("value").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("value")
    return lists.join(open_, "value", "left_semi").join(sets.select("rid", "values"), "rid")


def link(sets: DataFrame, k: int, percent: int, floor_shared: int, pivots: int, rounds: int) -> DataFrame:
    """(node, root) over the representatives with a verified link, by steps 2 and 3."""
    lists = written(postings(sets, k, percent, floor_shared), "near-postings")
    similar = _similar(k, percent, floor_shared)
    links, roots = None, None
    for asked in [pivots] * rounds + [None]:
        comp = lists.join(roots.toDF("rid", "comp"), "rid", "left").withColumn(
            "comp", F.coalesce("comp", "rid")) if roots is not None else lists.withColumn("comp", F.col("rid"))
        if asked:
            found = verified(written(candidates(comp, similar, asked), "near-pairs"), sets, percent)
        else:
            both = F.size(F.array_intersect("a.values", "b.values"))
            exact = 100 * both >= percent * (F.col("a.n") + F.col("b.n") - both)
            found = candidates(unsettled(comp, sets), similar & exact, None)
        links = written(found if links is None else links.union(found), "near-links")
        roots = connected_components(links)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, pivots: int = PIVOTS,
                    rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    floor_shared = shared_floor(k, percent)
    own = written(sketches(docs, words, k), "near-sketches")
    reps = written(own.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("print", "doc_id"), F.min("print")).alias("print"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("rid", F.monotonically_increasing_id()), "near-representatives")
    roots = link(survivors(docs, reps, words, percent, floor_shared), k, percent, floor_shared, pivots, rounds)
    named = reps.select("rid", "node", "doc_id").join(roots.toDF("rid", "root"), "rid", "left").select(
        "node", "doc_id", F.coalesce("root", "rid").alias("comp"))
    named = written(named, "near-components")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    members = named.select("node", "comp").join(least, "comp").select("node", "component_id")
    out = own.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(members, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
