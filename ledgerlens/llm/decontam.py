"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The test items are indexed by BM25 over pairs of adjacent words (single words are
too common to tell a passage from any other), with impacts divided by the item's score of
itself, so a passage's score for an item is the share of the item's BM25 mass
that it covers. Every document is cut into passages of twice the longest item
with half overlap, so each place of an item lies whole in one passage. Every
passage is a query: a bound from the largest impact of each of its pairs rules
most out, block-max WAND retrieves all items of ``threshold`` or more for the
rest. What a retrieved item must share with the passage to count:

* with ``part_overlap``, as the queries call it: ``min_overlap`` of the five-word
  shingles of question and answer together, and ``part_overlap`` of the three-word
  shingles of each, so that both are there. One changed word breaks five shingles,
  most of a short part but little of the item;
* without: ``min_overlap`` of the five-word shingles of each on its own.

Without columns for them, question and answer are the halves of the item's words.

Words are runs without white space and ASCII punctuation, A-Z lower-cased.
Document frequencies are counted over all items. The index goes to the tasks in
blocks of at most ``max_items`` items in the mean (by hash), one pass over the
documents each, so what is broadcast stays bounded however many items there are.

Defined cases: null and empty texts have no passages and are clean; items
of fewer than two words are ignored, parts with fewer words than a shingle count as
one shingle, an empty part is left out; equal items and repeated rows each get
their own result; without items everything is clean; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .text_kernels import BARE_WORDS, give_back, token_hashes, windows

K1 = 1.2
B = 0.75
THRESHOLD = 0.6
MIN_OVERLAP = 0.8
PART_OVERLAP = 0.25
SHINGLE = 5
PART_SHINGLE = 3
TERM = 2
BLOCK = 32
MAX_ITEMS = 20_000
_END = 1 << 60


def words(text: str | None) -> np.ndarray:
    _, hashes, _ = next(token_hashes([text], BARE_WORDS))
    return hashes


def shingles(hashes: np.ndarray, n: int = SHINGLE) -> tuple[int, np.ndarray]:
    """(length, distinct shingles); all words as one where there are fewer than ``n``."""
    n = min(n, len(hashes))
    return n, np.unique(windows(hashes, n)) if n else np.zeros(0, np.uint64)


def _held(sets: list[tuple[int, np.ndarray]], passage: np.ndarray, share: float) -> bool:
    return all(np.isin(own, windows(passage, n)).sum() >= share * len(own) for n, own in sets)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, text, question, answer, terms, tfs, dl) of the items that have terms."""
    fields = [items.schema["item_id"], *[T.StructField(c, T.StringType()) for c in ("text", "question", "answer")],
              T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.LongType())),
              T.StructField("dl", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [np.unique(windows(words(t), TERM), return_counts=True) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("item_id", "text", "question", "answer")],
                 pa.array([t.view(np.int64) for t, _ in counted], pa.list_(pa.int64())),
                 pa.array([n for _, n in counted], pa.list_(pa.int64())),
                 pa.array([int(n.sum()) for _, n in counted], pa.int64())], [f.name for f in fields])

    split = {"question", "answer"} <= set(items.columns)
    own = items.select("item_id", F.concat_ws("\n", "question", "answer").alias("text"), "question", "answer") if split \
        else items.select("item_id", "text", F.lit(None).cast("string").alias("question"),
                          F.lit(None).cast("string").alias("answer"))
    return written(own.mapInArrow(run, T.StructType(fields)).where("dl > 0"), "item-terms")


class Index:
    """Postings of one block of items with block maxima; ``search`` is block-max WAND."""

    def __init__(self, rows: list, df: dict[int, int], n_items: int, mean_dl: float):
        self.item_ids = [r["item_id"] for r in rows]
        self.parts, self.wholes, self.traces = [], [], []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, r in enumerate(rows):
            tf = np.array(r["tfs"], float)
            idf = np.log1p([(n_items - df[t] + 0.5) / (df[t] + 0.5) for t in r["terms"]])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * r["dl"] / mean_dl))
            for t, w in zip(r["terms"], (impact / impact.sum()).tolist()):
                postings[t].append((i, w))
            all_words = words(r["text"])
            half = (len(all_words) + 1) // 2
            parts = (words(r["question"]), words(r["answer"])) if r["question"] is not None or r["answer"] is not None \
                else (all_words[:half], all_words[half:])
            self.parts.append([shingles(p) for p in parts if len(p)])
            self.wholes.append([shingles(all_words)])
            self.traces.append([shingles(p, PART_SHINGLE) for p in parts if len(p)])
        self.longest = max((r["dl"] + TERM - 1 for r in rows), default=0)
        terms = np.array(sorted(postings), np.int64)
        order = np.argsort(terms.view(np.uint64))
        self.keys = terms.view(np.uint64)[order]
        self.lists = [postings[t] for t in terms[order].tolist()]
        self.items = [[i for i, _ in p] for p in self.lists]
        self.weights = [[w for _, w in p] for p in self.lists]
        self.largest = np.array([max(w) for w in self.weights])
        self.block_ends = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]
        self.block_max = [[max(w[k:k + BLOCK]) for k in range(0, len(w), BLOCK)] for w in self.weights]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for terms of no item."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of ``threshold`` or more for a query of distinct term numbers."""
        threshold -= 1e-9
        at = {t: 0 for t in terms}
        block = {t: 0 for t in terms}
        items, weights, ends, tops, largest = self.items, self.weights, self.block_ends, self.block_max, self.largest

        def doc(t: int) -> int:
            return items[t][at[t]] if at[t] < len(items[t]) else _END

        def seek(t: int, target: int) -> None:
            own, i = items[t], at[t]
            while i < len(own) and own[i] < target:
                i = min(i + BLOCK - i % BLOCK, len(own)) if ends[t][i // BLOCK] < target else i + 1
            at[t] = i

        found = []
        live = sorted(terms, key=doc)
        while live:
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                if doc(t) == _END:
                    break
                bound += largest[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            target = doc(live[pivot])
            while pivot + 1 < len(live) and doc(live[pivot + 1]) == target:
                pivot += 1
            bound, skip = 0.0, _END
            for t in live[:pivot + 1]:                       # shallow move to the block of the pivot
                b = block[t]
                while b < len(ends[t]) and ends[t][b] < target:
                    b += 1
                block[t] = b
                if b < len(ends[t]):
                    bound += tops[t][b]
                    skip = min(skip, ends[t][b] + 1)
            if bound < threshold:
                if pivot + 1 < len(live):
                    skip = min(skip, doc(live[pivot + 1]))
                for t in live[:pivot + 1]:
                    seek(t, max(skip, target + 1))
            elif doc(live[0]) == target:
                score = 0.0
                for t in live[:pivot + 1]:
                    score += weights[t][at[t]]
                    at[t] += 1
                if score >= threshold:
                    found.append((target, score))
            else:
                for t in live[:pivot + 1]:
                    seek(t, target)
            live = sorted((t for t in live if at[t] < len(items[t])), key=doc)
        return found

    def covers(self, item: int, passage: np.ndarray, min_overlap: float, part_overlap: float | None = None) -> bool:
        """Question and answer share enough shingles with the passage's words: each on its own, or with
        ``part_overlap`` both together, and each that much."""
        if part_overlap is None:
            return _held(self.parts[item], passage, min_overlap)
        return _held(self.wholes[item], passage, min_overlap) and _held(self.traces[item], passage, part_overlap)

    def matches(self, hashes: np.ndarray, bounds: np.ndarray, threshold: float, min_overlap: float,
                part_overlap: float | None = None) -> dict[int, dict[int, float]]:
        """Per row of a group of texts the verified items with their best scores."""
        out: dict[int, dict[int, float]] = {}
        term = np.full(len(hashes), -1)                      # of the pair that starts at each word
        if len(hashes) >= TERM:
            term[:1 - TERM] = self.lookup(windows(hashes, TERM))
        last = bounds[1:][np.diff(bounds) > 0]
        for step in range(1, TERM):
            term[np.maximum(last - step, 0)] = -1            # it would reach into the next text
        if not (term >= 0).any():
            return out
        size, stride = 2 * self.longest, self.longest
        sums = np.append(0.0, np.cumsum(np.where(term >= 0, self.largest[term], 0.0)))
        count = np.maximum(1, -(-(np.diff(bounds) - stride) // stride)) * (np.diff(bounds) > 0)
        row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = bounds[row] + nth * stride
        end = np.minimum(begin + size, bounds[row + 1])
        for r, a, b in zip(*[x[sums[end] - sums[begin] >= threshold - 1e-6].tolist() for x in (row, begin, end)]):
            terms = np.unique(term[a:b - TERM + 1])
            terms = terms[terms >= 0]
            if self.largest[terms].sum() < threshold - 1e-6:
                continue
            for item, score in self.search(terms.tolist(), threshold):
                if self.covers(item, hashes[a:b], min_overlap, part_overlap):
                    best = out.setdefault(r, {})
                    best[item] = max(score, best.get(item, 0.0))
        return out


def index_blocks(items: DataFrame, max_items: int = MAX_ITEMS) -> Iterator[Index]:
    """The index in blocks by hash of the item; document frequencies over all items."""
    rows = item_terms(items)
    n = rows.count()
    if not n:
        return
    mean = rows.agg(F.avg("dl")).first()[0]
    blocks = -(-n // max_items)
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df = written(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "item-df")
    for b in range(blocks):
        own = numbered.where(F.col("block") == b)
        used = own.select(F.explode("terms").alias("term")).distinct()
        known = {r["term"]: r["df"] for r in df.join(used, "term", "left_semi").collect()}
        got = sorted(own.drop("block").collect(), key=lambda r: (str(r["item_id"]), r["text"]))
        if got:
            yield Index(got, known, n, mean)


def with_matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP,
                 max_items: int = MAX_ITEMS, name: str = "__items", part_overlap: float | None = None) -> DataFrame:
    """``docs`` with an array ``name`` of (item_id, score), by falling score: the test items found in
    ``text``. The rows stay where they are; nothing is shuffled."""
    id_type = items.schema["item_id"].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())]))
    out = docs.withColumn(name, F.array().cast(kind))
    for index in index_blocks(items, max_items):
        out = _one_block(out, index, threshold, min_overlap, part_overlap, name)
    return out.withColumn(name, F.reverse(F.array_sort(F.transform(
        name, lambda x: F.struct(x["score"].alias("score"), x["item_id"].alias("item_id"))))))


def _one_block(docs: DataFrame, index: Index, threshold: float, min_overlap: float, part_overlap: float | None,
               name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            old = batch.column(columns.index(name))
            found: dict[int, dict[int, float]] = {}
            for first, hashes, bounds in token_hashes(batch.column(columns.index("text")).to_pylist(), BARE_WORDS):
                for r, items in own.matches(hashes, bounds, threshold, min_overlap, part_overlap).items():
                    found[first + r] = items
            if found:
                new = old.to_pylist()
                for r, items in found.items():
                    new[r] = new[r] + [{"item_id": own.item_ids[i], "score": s} for i, s in items.items()]
                old = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, columns) if n != name], old],
                                             [*[n for n in columns if n != name], name])
        give_back()

    columns = docs.columns
    schema = T.StructType([*[f for f in docs.schema if f.name != name], docs.schema[name]])
    return docs.mapInArrow(run, schema)
