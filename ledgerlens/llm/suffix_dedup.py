"""Removal of repeated byte strings by the Burrows-Wheeler transform of many documents at once.

A byte goes when it is covered by a string of ``length`` bytes that also starts
earlier: in a document of smaller id, or earlier in the same document. Strings are
judged on the input; matches never cross documents.

The transform is built column by column (``collection_bwt``), which is only
affordable for many short strings, and must not be one structure in one task. So
the windows (stretches of ``length`` bytes) are dealt out by their content first:

1. a window's anchor is its leftmost ``ANCHOR``-byte string of least hash. Equal
   windows have equal anchors at equal places, so they meet under one key, and all
   windows that one anchor answers for lie next to each other: they are handed on as
   one string, window after window, of less than twice the length;
2. strings under an anchor that no other place has are unlike all others. Equal
   strings are counted by partial aggregation: all but the earliest go as a whole,
   so a passage with thousands of copies is one string from here on;
3. keys that still hold different strings are told apart further: the windows that
   have the anchor in their left or right half share another ``length / 2`` bytes, which
   make the new key, and so on while a key has more than ``split`` strings. A key of
   one place holds equal windows only, so this ends, and no key is large;
4. the keys are dealt to tasks by total size. Each task builds transform and common
   prefixes of its strings in files below the shared scratch folder, and reads the
   classes of equal windows off them; of each class the earliest place stays.

The covered stretches meet their document again in a join on its id, and the bytes
are cut out there. No cap drops a place; keys are 64-bit hashes of the anchor beside
64-bit hashes of the string, and the classes of step 4 rest on the bytes themselves.
The files are opened with pyarrow, so the scratch folder must be on a file system
that it knows; a task removes its own when it ends.

Defined cases: null and empty texts have no bytes; documents shorter than ``length``
lose none; repeated rows of one id are documents in the order of their text, so one
of several equal rows stays; rows without an id come after all others, in the order of
their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import scratch_path

from .collection_bwt import CollectionBwt
from .common import written
from .text_kernels import give_back, mix
from .warc import _open as open_store

LENGTH = 100
ANCHOR = 16
SPLIT = 2000
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 1 << 15
STRETCH = 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(24)


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): rid is the id where ids are whole numbers, given and unique; else the row's
    place in the order of id (none last) and text, in a written copy."""
    rows = docs.select("doc_id", "text")
    if isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
            return rows.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text")
    ordered = rows.sort(F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return written(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "suffix-rows")


def anchored_strings(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents in ``raw`` (each at least ``length`` bytes): key, string hash, first window, length of the
    string, and place of the anchor in it."""
    x = raw.astype(np.uint64)
    for size in (1, 2, 4):
        more = x[size:] << np.uint64(8 * size)
        more |= x[:-size]
        x = more
    eight = mix(x)
    hashes = eight[:-8] * _ODD
    hashes += eight[8:]
    hashes = mix(hashes)                                             # of ANCHOR = 16 bytes
    coded = hashes >> _PLACE_BITS
    coded <<= _PLACE_BITS
    coded |= np.arange(len(hashes), dtype=np.uint64)
    wide, width = length - ANCHOR + 1, 1
    while 2 * width <= wide:
        coded, width = np.minimum(coded[:-width], coded[width:]), 2 * width
    rest = wide - width
    coded = np.minimum(coded[:len(coded) - rest], coded[rest:])
    at = (coded & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    stop = starts + sizes - length + 1                               # one past a document's last window
    begins = np.zeros(len(at) + 1, bool)
    begins[1:-1] = at[1:] != at[:-1]
    begins[starts] = True
    begins[stop] = True
    edges = np.flatnonzero(begins)
    first, last = edges[:-1], edges[1:] - 1
    own = np.searchsorted(starts, first, "right") - 1
    inside = first < stop[own]
    first, last = first[inside], last[inside]
    end = last + length
    string = mix((end - first).astype(np.uint64) * _ODD + (at[first] - first).astype(np.uint64))
    for i in range(-(-(2 * length) // ANCHOR)):
        string *= _ODD
        string += hashes[np.minimum(first + i * ANCHOR, end - ANCHOR)]
        string ^= string >> np.uint64(29)
    string = mix(string)
    return hashes[at[first]].view(np.int64), string.view(np.int64), first, end - first, at[first] - first


#: A place in a document, the length of the string there and its anchor's place in one number, ordered by place.
def _packed(start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start << 20) | (size << 10) | anchor


def _unpacked(span: int) -> tuple[int, int, int]:
    return span >> 20, (span >> 10) & 1023, span & 1023


def places(rows: DataFrame, length: int) -> DataFrame:
    """(key, string, rid, span) of every string of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            sizes = np.array([len(d) for _, _, d in group], np.int64)
            starts = np.cumsum(sizes) - sizes
            raw = np.frombuffer(b"".join(d for _, _, d in group), np.uint8)
            key, string, first, size, anchor = anchored_strings(raw, starts, sizes, length)
            own = np.searchsorted(starts, first, "right") - 1
            rid = np.array([r for r, _, _ in group], np.int64)[own]
            place = first - starts[own] + np.array([o for _, o, _ in group], np.int64)[own]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (key, string, rid, _packed(place, size, anchor))],
                                              ["key", "string", "rid", "span"])

        group, held = [], 0
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for row, rid in enumerate(batch["rid"].to_pylist()):
                data = texts[row].as_py() or b""
                for at in range(0, len(data) - length + 1, STRETCH):
                    group.append((rid, at, data[at:at + STRETCH + length - 1]))
                    held += len(group[-1][2])
                    if held >= GROUP_BYTES:
                        yield out(group)
                        group, held = [], 0
        if group:
            yield out(group)
        give_back()

    return rows.select("rid", "text").mapInArrow(run, "key long, string long, rid long, span long")


def settled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of places (key, string, rid, span): (rid, span) of the copies, that is all but the earliest of each
    string; and (key, strings, rid, span) of the earliest ones under keys that hold several strings."""
    owners = written(found.groupBy("key", "string").agg(F.min(F.struct("rid", "span")).alias("own"),
                                                        F.count("*").alias("n")), "suffix-strings")
    keys = written(owners.groupBy("key").agg(F.count("*").alias("strings")).where("strings > 1"), "suffix-keys")
    contested = owners.join(keys, "key").select("key", "strings", "own.rid", "own.span")
    here = F.struct("rid", "span")
    copies = found.join(owners.where("n > 1").select("key", "string", "own"), ["key", "string"]).where(
        here != F.col("own")).select("rid", "span")
    return copies, contested


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


STRINGS = "key long, string long, rid long, span long, low int, high int, text binary"


def halves(key: int, text: bytes, rid: int, span: int, low: int, high: int, length: int) -> Iterator[tuple]:
    """A string's windows with the anchor ``low`` to ``high`` bytes from their start, as two strings with keys of
    the bytes that all windows of a half share."""
    start, _, anchor = _unpacked(span)
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        first, last = max(0, anchor - b), min(len(text) - length, anchor - a)
        if a <= b and first <= last:
            own = text[first:last + length]
            shared = text[anchor - a:anchor - b + length]
            place = (anchor - first).to_bytes(2, "little")
            yield (_hash(bytes((a & 255, a >> 8, b & 255, b >> 8)), shared), _hash(place, own), rid,
                   ((start + first) << 20) | (len(own) << 10) | (anchor - first), a, b, own)


def _string_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in STRINGS.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def read_strings(rows: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """The contested strings in halves, read from their documents."""
    wanted = contested.groupBy("rid").agg(F.collect_list(F.struct("key", "span")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in batches:
                texts = batch["text"].cast(pa.binary())
                for row, (rid, own) in enumerate(zip(batch["rid"].to_pylist(), batch["wanted"])):
                    data = texts[row].as_py()
                    for key, span in zip(own.values.field("key").to_pylist(), own.values.field("span").to_pylist()):
                        start, size, _ = _unpacked(span)
                        yield from halves(key, data[start:start + size], rid, span, 0, length - ANCHOR, length)
        yield from _string_batches(out())
        give_back()

    return rows.select("rid", "text").join(wanted, "rid").mapInArrow(run, STRINGS)


def split_further(strings: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _string_batches(
            half for batch in batches
            for row in zip(*[batch[c].to_pylist() for c in ("key", "text", "rid", "span", "low", "high")])
            for half in halves(*row, length))

    return strings.select("key", "text", "rid", "span", "low", "high").mapInArrow(run, STRINGS)


def repeats(strings: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(rid, start, stop): stretches covered by windows of ``strings`` (key, rid, span, text) that occur earlier."""
    total = strings.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = scratch_path(strings.sparkSession, "suffix-columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, spans, texts = [], [], []
        for batch in batches:
            rids += batch["rid"].to_pylist()
            spans += batch["span"].to_pylist()
            texts += batch["text"].to_pylist()
        if not texts:
            return
        store, base = open_store(folder)
        own = posixpath.join(base, uuid.uuid4().hex)
        try:
            string, start, kind = CollectionBwt(texts, store, own, cap=length).build().repeated_windows()
        finally:
            store.delete_dir(own)
        rid, place = np.array(rids, np.int64)[string], (np.array(spans, np.int64) >> 20)[string] + start
        order = np.lexsort((place, rid, kind))
        rid, place, kind = rid[order], place[order], kind[order]
        later = np.flatnonzero(kind[1:] == kind[:-1]) + 1
        rid, place = rid[later], place[later]
        order = np.lexsort((place, rid))
        rid, place = rid[order], place[order]
        first = np.ones(len(rid), bool)
        first[1:] = (rid[1:] != rid[:-1]) | (place[1:] > place[:-1] + 1)
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(rid)) - 1 if len(head) else head
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (rid[head], place[head], place[tail] + length)],
                                         ["rid", "start", "stop"])
        give_back()

    tasks = strings.select("key", "rid", "span", "text").repartition(max(1, -(-total // bucket_bytes)), "key")
    return tasks.mapInArrow(run, "rid long, start long, stop long")


def repeated_stretches(rows: DataFrame, length: int = LENGTH, split: int = SPLIT, bucket_bytes: int = BUCKET_BYTES
                       ) -> DataFrame:
    """(rid, start, stop): stretches of the documents (rid, text) to remove; they may overlap."""
    every = places(rows, length)
    shared = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-shared")
    found = written(every.join(shared, "key"), "suffix-places")
    copies, contested = settled(found)
    spans = [copies]
    strings = written(read_strings(rows, contested, length), "suffix-halves")
    ready = []
    while True:
        copies, contested = settled(strings.select("key", "string", "rid", "span"))
        spans.append(copies)
        kept = written(strings.join(contested, ["key", "rid", "span"]).select(
            "key", "rid", "span", "low", "high", "text", "strings"), "suffix-contested")
        ready.append(kept.where(F.col("strings") <= split))
        large = kept.where(F.col("strings") > split)
        if large.isEmpty():
            break
        strings = written(split_further(large, length), "suffix-halves")
    few = ready[0]
    for more in ready[1:]:
        few = few.union(more)
    out = repeats(few, length, bucket_bytes)
    start = F.shiftright("span", 20)
    for copies in spans:
        out = out.union(copies.select("rid", start.alias("start"), (start + F.shiftright("span", 10) % 1024).alias("stop")))
    return out


def cut(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, ``removed`` (maximal stretches as structs start, stop) and ``kept``, the remaining bytes."""
    per_row = stretches.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch["text"].cast(pa.binary()), batch["spans"]
            sizes, gone, removed, kept = [], [], [], []
            for row in range(len(texts)):
                data = texts[row].as_py() or b""
                merged, parts, at = [], [], 0
                if spans[row].is_valid:
                    own = spans[row].values
                    for start, stop in sorted(zip(own.field("start").to_pylist(), own.field("stop").to_pylist())):
                        if merged and start <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(merged[-1]["stop"], stop)
                        else:
                            merged.append({"start": start, "stop": stop})
                for m in merged:
                    parts.append(data[at:m["start"]])
                    at = m["stop"]
                parts.append(data[at:])
                sizes.append(len(data))
                gone.append(sum(m["stop"] - m["start"] for m in merged))
                removed.append(merged)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(removed, arrow_spans), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept"])
        give_back()

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", span_type),
                           T.StructField("kept", T.BinaryType())])
    return rows.join(per_row, "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, split: int = SPLIT, bucket_bytes: int = BUCKET_BYTES
                   ) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, removed, kept."""
    if not 2 * ANCHOR <= length <= 254:
        raise ValueError(f"length must be from {2 * ANCHOR} to 254")
    rows = numbered(docs)
    return cut(rows, repeated_stretches(rows, length, split, bucket_bytes))
