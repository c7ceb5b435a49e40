"""Exact token ids of whole texts by a public word-level BPE file, at batch speed.

The tokenizer normalises (NFC, lower case), cuts at white space and at borders
between letters, single digits and other characters, and runs BPE inside these
pieces only. So a text's ids are those of its pieces in a row, and a worker
encodes equal pieces once. Cutting, hashing and joining are numpy work on bytes:
chunks between ASCII white space that consist of ASCII and precomposed Latin-1
letters are cut at those borders; any other chunk (other scripts, combining
marks, apostrophes, special tokens) is given to the tokenizer whole. Pieces are
looked up by 64-bit hash among at most ``MAX_CACHED`` others. Null counts as
empty. A full cache is emptied, which costs time, never results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .text_kernels import FOLD, SPACES, place_hashes

SLICE_BYTES = 1 << 20
MAX_CACHED = 400_000
_LETTER, _OTHER, _DIGIT = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(SPACES)] = 0
_KIND[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = _LETTER
_KIND[list(range(48, 58))] = _DIGIT
_ENCODERS: dict[str, Encoder] = {}


def _pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whole) of the pieces of a buffer that ends with a separator."""
    kind = _KIND[raw]
    solid = kind != 0
    begins = solid & (kind == _DIGIT)
    change = np.empty(len(raw), bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    begins |= solid & change
    stops = np.flatnonzero(change[1:] & solid[:-1]) + 1              # ends of runs of one kind
    odd = raw >= 128
    if odd.any():
        before = np.empty(len(raw), np.uint8)
        before[0], before[1:] = 0, raw[:-1]
        odd &= ~((raw == 0xC3) | ((before == 0xC3) & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7)))
    odd |= raw == 39                                                 # an apostrophe may start a suffix
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)                  # <| starts the special tokens
    starts = np.flatnonzero(begins)
    if not odd.any():
        digit = kind[starts] == _DIGIT
        ends = np.where(digit, starts + 1, stops[np.minimum(np.searchsorted(stops, starts, "right"), len(stops) - 1)])
        return starts, ends, np.zeros(len(starts), bool)
    first = np.flatnonzero(solid & np.append(True, ~solid[:-1]))     # chunks between white space
    last = np.flatnonzero(~solid & np.append(False, solid[:-1]))
    total = np.append(0, np.cumsum(odd))
    whole_chunk = total[last] > total[first]
    chunk = np.searchsorted(first, starts, "right") - 1
    whole = whole_chunk[chunk]
    keep = ~whole | (starts == first[chunk])
    starts, chunk, whole = starts[keep], chunk[keep], whole[keep]
    digit = kind[starts] == _DIGIT
    ends = np.where(digit, starts + 1, stops[np.searchsorted(stops, starts, "right")])
    return starts, np.where(whole, last[chunk], ends), whole


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)                   # sorted hashes of known pieces
        self.at = np.zeros(0, np.int64)                      # their numbers
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode_each(self, strings: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_pieces(self, strings: list[str]) -> list[np.ndarray]:
        """Encode pieces in long strings; each ends with a token that ends a word."""
        out = []
        for i in range(0, len(strings), 500):
            group = strings[i:i + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                out += [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
            else:
                out += self._encode_each(group)
        return out

    def _learn(self, keys: np.ndarray, strings: list[str], whole: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MAX_CACHED:
            self._forget()
        cut = self._encode_pieces([s for s, w in zip(strings, whole) if not w])
        rest = self._encode_each([s for s, w in zip(strings, whole) if w])
        encoded = cut + rest
        keys = np.append(keys[~whole], keys[whole])
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *encoded])
        at = np.append(self.at, len(self.start) + np.arange(len(keys)))
        keys = np.append(self.keys, keys)
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.at[i], self.keys[i] == keys

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``."""
        data = [b"" if t is None else t.encode() for t in texts.to_pylist()]
        joined = b"\n".join(data) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        edges = np.append(0, np.cumsum([len(d) + 1 for d in data]))
        starts, ends, whole = _pieces(raw)
        bounds = np.searchsorted(starts, edges)
        if not len(starts):
            return np.zeros(0, np.uint32), bounds
        keys = place_hashes(raw, starts, ends, FOLD)
        for i in np.flatnonzero(whole).tolist():
            keys[i] = xxhash.xxh64_intdigest(joined[starts[i]:ends[i]], 7)
        coded = pa.array(keys).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        number, known = self._known(distinct)
        if not known.all():
            sample = np.zeros(len(distinct), np.int64)
            sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)          # where each first occurs
            for wanted in (~known, None):
                rows = sample[wanted] if wanted is not None else sample
                names = [joined[a:b].decode() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
                self._learn(keys[rows], names, whole[rows])
                number, known = self._known(distinct)
                if known.all():                                              # else the cache was emptied meanwhile
                    break
        size = self.size[number]
        each = size[codes]
        stop = np.cumsum(each)
        at = np.repeat(self.start[number][codes] - (stop - each), each)
        at += np.arange(len(at))
        return self.ids[at], np.append(0, stop)[bounds]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.encode(texts)[1])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row groups of about ``limit`` text bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
