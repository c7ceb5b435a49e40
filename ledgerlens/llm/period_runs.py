"""Periodic runs of words, found online by catching squares with dyadic blocks.

A run is a stretch of words with smallest period ``q`` that is at least
``exponent`` periods (and ``min_words`` words) long and that no neighbouring word
extends with the same period. ``SquareCatchers`` reads a text word by word, or any
number of words at a time, with the same result:

* every completed block of ``2**k`` words ``[m * 2**k, (m + 1) * 2**k)`` becomes a
  catcher, which listens while the next ``2**(k + 1)`` words arrive: the suffix of
  ``2**k`` words behind each appended word is compared with the block. A hit at
  distance ``q`` has ``2**k <= q < 2**(k + 1)``, so at most two catchers of a level
  listen at a time and an appended word costs one comparison per level;
* a run of period ``q`` in that range and at least 3 periods long holds a block and
  its copy ``q`` words later, so a catcher sees it; its comparison is then advanced
  to the left and, while words are appended, to the right. It holds a square as
  soon as it spans two periods;
* squares of one period that overlap by a period are one region by construction;
  regions inside a region of a lower level repeat a shorter word (Fine and Wilf)
  and are dropped. Regions that got long enough are the runs.

Suffixes are compared by hash first; every region is confirmed on exact word
numbers, so no result rests on a hash. A text takes time in proportion to
(words) x (levels), and memory for its own words; texts never meet, so any
number of tasks share the work without a shuffle.

Defined cases: null and empty texts and texts of white space have no words and
no runs, and collapse to the empty text; rows without an id and repeated rows
are judged like any others, each on its own; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_kernels import give_back, mix

EXPONENT = 4
MIN_WORDS = 6
FLUSH_BYTES = 1 << 23

RUN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
                    T.StructField("period", T.LongType(), False)])


class SquareCatchers:
    """Online detector; ``append`` takes the next word numbers, ``runs`` reports those seen so far."""

    def __init__(self, exponent: int = EXPONENT, min_words: int = MIN_WORDS):
        if exponent < 3:
            raise ValueError("the catchers see every region of three periods or more")
        self.exponent, self.min_words = exponent, min_words
        self.words = np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = []                  # level -> hash of every suffix of 2**level words
        self.regions: list[list[list[int]]] = []            # level -> [start, end, period]
        self.last: dict[int, list[int]] = {}                # period -> its latest region
        self.open: list[list[int]] = []                     # regions that reach the end of the words read

    def _equal_to_right(self, at: int, period: int) -> int:
        """First place ``x >= at`` whose word differs from the one ``period`` later, or the end."""
        words, stop, step = self.words, len(self.words) - period, 16
        while at < stop:
            to = min(at + step, stop)
            same = words[at:to] == words[at + period:to + period]
            if not same.all():
                return at + int(same.argmin())
            at, step = to, step * 4
        return max(at, stop)

    def _equal_to_left(self, at: int, period: int) -> int:
        """Smallest start of the equal places that end before ``at``."""
        words, step = self.words, 16
        while at > 0:
            down = max(at - step, 0)
            same = words[down:at] == words[down + period:at + period]
            if not same.all():
                return at - int(same[::-1].argmin())
            at, step = down, step * 4
        return 0

    def _suffixes(self, level: int) -> np.ndarray:
        """Hashes of all suffixes of ``2**level`` words, carried on from those of the words read before."""
        size = 1 << level
        if level == len(self.hashes):
            self.hashes.append(np.zeros(0, np.uint64))
            self.regions.append([])
        known = len(self.hashes[level])
        if level == 0:
            new = mix(self.words[known:].astype(np.uint64) + np.uint64(1))
        else:
            half = self.hashes[level - 1]
            new = mix(half[known:len(self.words) - size + 1] * np.uint64(0x9E3779B97F4A7C15)
                      + half[known + size // 2:])
        self.hashes[level] = np.concatenate([self.hashes[level], new]) if known else new
        return self.hashes[level]

    def append(self, words: np.ndarray) -> list[list[int]]:
        """Read on; returns the regions (start, end, period) that now hold a square and did not before."""
        before = len(self.words)
        self.words = np.concatenate([self.words, words]) if before else words
        after, squares, still_open = len(self.words), [], []
        for region in self.open:
            start, end, period = region
            region[1] = self._equal_to_right(end - period, period) + period
            if end - start < 2 * period <= region[1] - start:
                squares.append(region)
            if region[1] == after:
                still_open.append(region)
        self.open = still_open
        level = 0
        while 2 << level <= after:
            size = 1 << level
            suffixes = self._suffixes(level)
            at = np.arange(max(before - size + 1, size), after - size + 1)
            block = (at // size - 1) * size
            hit = np.flatnonzero(suffixes[at] == suffixes[block])
            if len(hit):
                block, period = block[hit], at[hit] - block[hit]
                own = self._not_inside(level, block, block + period + size)
                for i, q in zip(block[own].tolist(), period[own].tolist()):
                    latest = self.last.get(q)
                    if latest and latest[0] <= i and i + q + size <= latest[1]:
                        continue
                    end = self._equal_to_right(i, q) + q
                    if end < i + q + size:                      # equal hashes of unequal words
                        continue
                    region = [self._equal_to_left(i, q), end, q]
                    self.last[q] = region
                    self.regions[level].append(region)
                    if end - region[0] >= 2 * q:
                        squares.append(region)
                    if end == after:
                        self.open.append(region)
            level += 1
        return squares

    def _not_inside(self, level: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indices of the stretches that lie in no region of a lower level."""
        lower = sorted(r for regions in self.regions[:level] for r in regions if r[1] - r[0] >= 2 * r[2])
        if not lower:
            return np.arange(len(start))
        starts = np.array([r[0] for r in lower])
        ends = np.maximum.accumulate([r[1] for r in lower])
        left = np.searchsorted(starts, start, "right") - 1
        return np.flatnonzero((left < 0) | (ends[left] < end))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted((s, e - s, q) for regions in self.regions for s, e, q in regions
                      if e - s >= max(self.min_words, self.exponent * q))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def find_runs(numbers: np.ndarray, exponent: int = EXPONENT, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    catchers = SquareCatchers(exponent, min_words)
    catchers.append(numbers)
    return catchers.runs()


def collapsed_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay: of every run its first period, and all words outside runs."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, min_words: int = MIN_WORDS,
                  rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ``runs`` (structs start, length, period in words, by start and
    period) and ``collapsed``, the words that stay joined by one space.

    ``rewrite(doc_id, n)`` may name the places of the words to judge in place of the ``n`` words of the text.
    """
    fields = [docs.schema["doc_id"], T.StructField("runs", T.ArrayType(RUN, False), False),
              T.StructField("collapsed", T.StringType(), False)]
    run_type = pa.list_(pa.struct([(f, pa.int64()) for f in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids):
            return pa.RecordBatch.from_arrays([ids, pa.array(found, run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                                              ["doc_id", "runs", "collapsed"])

        for batch in batches:
            found, kept, size, first = [], [], 0, 0
            texts = batch["text"].cast(pa.binary())
            for row, doc_id in enumerate(batch["doc_id"].to_pylist()):
                words = (texts[row].as_py() or b"").split()          # bytes split at 0x20 and 0x09-0x0D only
                places = rewrite(doc_id, len(words)) if rewrite else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                runs = find_runs(word_numbers(words), exponent, min_words)
                if runs:
                    words = [words[i] for i in collapsed_words(len(words), runs).tolist()]
                found.append([dict(zip(RUN.names, r)) for r in runs])
                kept.append(b" ".join(words))
                size += len(kept[-1])
                if size >= FLUSH_BYTES:
                    yield out(batch["doc_id"].slice(first, row + 1 - first))
                    found, kept, size, first = [], [], 0, row + 1
            if found:
                yield out(batch["doc_id"].slice(first))
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def longest_run(runs: str = "runs"):
    """The run with the greatest length as a struct (ties: smallest start, then period); null without runs."""
    key = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                           (-r["period"]).alias("period"))))
    return F.when(key.isNotNull(), F.struct((-key["start"]).alias("start"), key["length"].alias("length"),
                                            (-key["period"]).alias("period")))
