"""Vectorised tokenising and hashing of text batches with numpy, used inside Spark tasks.

Texts are handled a few hundred kilobytes at a time, so memory stays bounded by
the longest single text. A token is a maximal run of bytes of one non-zero
class; its hash depends on its (case-folded) bytes only, never on its place.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_POSITIONS = 1 << 14
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, _POSITIONS, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NO_FOLD = np.arange(256, dtype=np.uint8)


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: Spark keeps Python
    workers, and what their allocators hold would add up beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
    if trim:
        trim(0)


def classes(spaces: bytes, punctuation: bytes = b"") -> np.ndarray:
    """Class 0 for separators, 2 for ``punctuation``, 1 for every other byte."""
    out = np.ones(256, np.uint8)
    out[list(punctuation)] = 2
    out[list(spaces)] = 0
    return out


SPACES = b"\x20\t\n\x0b\x0c\r"
#: ASCII characters that are neither letters, digits nor control characters.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
WORDS = classes(SPACES)                                  # words of the contracts: anything between white space
WORDS_AND_MARKS = classes(SPACES, PUNCTUATION)           # words, and runs of punctuation, apart
BARE_WORDS = classes(SPACES + PUNCTUATION)               # words without punctuation


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(texts: list[str | None], kinds: np.ndarray, fold: np.ndarray = FOLD
                 ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, hashes, bounds) for consecutive groups of rows: row
    ``first + i`` has the tokens ``hashes[bounds[i]:bounds[i + 1]]``. Null counts as empty."""
    weight = _BYTE[fold].copy()
    weight[kinds == 0] = 0
    first, group, size = 0, [], 0
    for row, text in enumerate(texts):
        data = b"" if text is None else text.encode()
        group.append(data)
        size += len(data) + 1
        if size >= CHUNK_BYTES:
            yield first, *_group_hashes(group, kinds, weight)
            first, group, size = row + 1, [], 0
    if group:
        yield first, *_group_hashes(group, kinds, weight)


def _group_hashes(group: list[bytes], kinds: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    kind = kinds[raw]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    starts = np.flatnonzero(begins)
    edges = np.zeros(len(group) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in group], out=edges[1:])
    bounds = np.searchsorted(starts, edges)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    origin = starts[0]
    raw, starts = raw[origin:], (starts - origin).astype(np.int32)
    size = np.diff(starts, append=np.int32(len(raw)))                       # with the separators behind, which weigh nothing
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts, size)
    if size.max() > _POSITIONS:
        final = kind[origin:] != 0
        final[:-1] &= kind[origin:-1] != kind[origin + 1:]
        size = np.flatnonzero(final) + 1 - starts
    return _span_hashes(weight[raw] * _PLACE[place & (_POSITIONS - 1)], starts, size), bounds


def _span_hashes(weighted: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans from their weighted bytes; up to the next span's start, bytes beyond ``size`` weigh nothing.
    Places repeat after a block of ``_POSITIONS`` bytes, so the blocks of longer spans are hashed apart and
    chained with a multiplier of the block's number."""
    blocks = -(-size.astype(np.int64) // _POSITIONS)
    if blocks.max() <= 1:
        return mix(np.add.reduceat(weighted, starts))
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    each = mix(np.add.reduceat(weighted, np.repeat(starts, blocks) + number * _POSITIONS))
    chained = mix(np.add.reduceat(each * (mix(number.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), first))
    return np.where(blocks == 1, each[first], chained)


def place_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Hashes of the given spans of a buffer; spans are ordered and do not overlap."""
    size = (ends - starts).astype(np.int32)
    stop = np.cumsum(size)
    place = np.arange(stop[-1], dtype=np.int32) - np.repeat(stop - size, size).astype(np.int32)
    at = np.repeat(starts.astype(np.int32), size) + place
    return _span_hashes(_BYTE[fold[raw[at]]] * _PLACE[place & (_POSITIONS - 1)], stop - size, size)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive tokens (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m] * _STEP[0]
    for i in range(1, n):
        total = total + hashes[i:i + m] * _STEP[i]
    return mix(total)


def shingle_sets(texts: list[str | None], n: int, kinds: np.ndarray = WORDS) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes (63 bits) of its ``n``-word shingles; a shorter
    text with words has one shingle, its whole word sequence; without words none."""
    for _, hashes, bounds in token_hashes(texts, kinds):
        grams = windows(hashes, n) >> np.uint64(1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1]).view(np.int64)
            elif b > a:
                short = windows(np.append(hashes[a:b], np.uint64(b - a)), b - a + 1) >> np.uint64(1)
                yield short.view(np.int64)
            else:
                yield np.zeros(0, np.int64)
