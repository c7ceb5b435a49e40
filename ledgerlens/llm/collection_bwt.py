"""Burrows-Wheeler transform and common prefixes of a collection of strings, column by column.

Round ``j`` inserts the suffix of length ``j`` of every string that is long enough,
so one symbol per string, into the sorted list of all shorter suffixes. Only two
sequences are kept, side by side in an external file that a round reads from start to
end, twice, and writes anew:

* the transform: for each suffix, in sorted order, the symbol before it;
* the common prefix of each suffix with the one sorted before it, up to ``cap``.

The new suffix ``c + x`` goes behind as many suffixes beginning with ``c`` as the
transform has ``c`` before the place of ``x``. Its common prefix is one more than the
least common prefix between ``x`` and the last place before it that has ``c``; the
suffix that follows it is updated alike. One sequential pass per round, with
counts and running minima per symbol, finds both; a second one merges.

Strings are bytes without 0xFF (UTF-8 never has it), which marks their start here.
Equal suffixes of different strings are kept apart by the strings' order. Memory
holds a chunk of the file and a few numbers per string.
"""

from __future__ import annotations

import posixpath

import numpy as np

CHUNK = 1 << 17
START = 0xFF


class _LeastOf:
    """Least value of any stretch of a chunk, by a table over stretches of power-of-two lengths."""

    def __init__(self, values: np.ndarray):
        self.table = np.empty((len(values).bit_length(), len(values)), np.uint8)
        self.table[0] = values
        for k in range(1, len(self.table)):
            size, last = 1 << k - 1, self.table[k - 1]
            stop = len(values) - 2 * size + 1
            np.minimum(last[:stop], last[size:size + stop], out=self.table[k, :stop])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Per pair the least of ``values[first:last + 1]``; 255 where that is empty."""
        width = last - first + 1
        some = width > 0
        level = np.frexp(np.where(some, width, 1).astype(np.float32))[1] - 1
        first, last = np.where(some, first, 0), np.where(some, last - (1 << level) + 1, 0)
        return np.where(some, np.minimum(self.table[level, first], self.table[level, last]), np.uint8(255))


class CollectionBwt:
    """Builds both sequences of ``strings`` below ``folder`` of the file system ``store`` (pyarrow)."""

    def __init__(self, strings: list[bytes], store, folder: str, cap: int, chunk: int = CHUNK):
        if not 0 < cap < 255:
            raise ValueError("common prefixes are kept in a byte")
        if any(not s for s in strings):
            raise ValueError("strings must not be empty")
        self.store, self.folder, self.cap, self.chunk = store, folder, cap, chunk
        self.symbols = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.round = 0
        self.total = np.zeros(256, np.int64)               # symbols in the transform
        self.active = np.arange(len(strings))              # strings not yet inserted as a whole
        self.places = np.arange(len(strings))              # rows of their suffixes inserted last
        self.rows = len(strings)
        store.create_dir(folder, recursive=True)
        first = self.symbols[self.ends - 1]
        self._count(first)
        with self._out(0) as rows:
            rows.write((first.astype(np.uint16) << 8).tobytes())

    def _path(self, number: int) -> str:
        return posixpath.join(self.folder, f"rows-{number}")

    def _out(self, number: int):
        return self.store.open_output_stream(self._path(number), compression=None)

    def _in(self, number: int):
        return self.store.open_input_stream(self._path(number), compression=None)

    def _count(self, symbols: np.ndarray) -> None:
        self.total += np.bincount(symbols, minlength=256)

    def build(self) -> CollectionBwt:
        while len(self.active):
            self._insert()
        return self

    def _insert(self) -> None:
        by_place = np.argsort(self.places)
        self.active, self.places = self.active[by_place], self.places[by_place]
        to, prefix, followers = self._find()
        self.round += 1
        before = self.ends[self.active] - 1 - self.round
        more = self.sizes[self.active] > self.round
        symbols = np.where(more, self.symbols[np.where(more, before, 0)], START).astype(np.uint8)
        self._merge(to, symbols, prefix, *followers)
        self._count(symbols)
        self.active, self.places = self.active[more], to[more]

    def _find(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """New rows and common prefixes of the suffixes to insert (in the order of ``active``),
        and those of the rows that follow them."""
        begins = len(self.sizes) + np.cumsum(self.total) - self.total      # first row of each symbol
        seen, least = np.zeros(256, np.int64), np.full(256, 255, np.uint8)
        last_new = np.zeros(256, bool)                    # was the symbol's last row inserted last round?
        to, prefix = np.zeros(len(self.places), np.int64), np.zeros(len(self.places), np.uint8)
        after, after_prefix = [], []
        with self._in(self.round) as rows:
            for base in range(0, self.rows, self.chunk):
                both = np.frombuffer(rows.read(2 * min(self.chunk, self.rows - base)), np.uint16)
                b, p = (both >> 8).astype(np.uint8), both.astype(np.uint8)
                lo, hi = np.searchsorted(self.places, [base, base + len(b)])
                new = np.zeros(len(b), bool)
                new[self.places[lo:hi] - base] = True
                order = np.argsort(b, kind="stable")
                here = np.bincount(b, minlength=256)
                sym = np.repeat(np.arange(256, dtype=np.uint8), here)
                group = np.cumsum(here) - here
                head = np.zeros(len(b), bool)
                present = np.flatnonzero(here)
                head[group[present]] = True
                new_in_order = new[order]
                behind_new = np.roll(new_in_order, 1)
                behind_new[head] = last_new[sym[head]]
                at = np.flatnonzero((new_in_order | behind_new) & (sym != START))
                s, row = sym[at], order[at]
                least_of = _LeastOf(p)
                first = np.where(head[at], 0, order[at - 1] + 1)
                value = least_of(first, row)
                value = np.where(head[at], np.minimum(value, least[s]), value)
                rank = seen[s] + at - group[s]
                value = np.where(rank > 0, np.minimum(value.astype(np.int64) + 1, self.cap), 0).astype(np.uint8)
                target, is_new = begins[s] + rank, new_in_order[at]
                slot = lo + np.searchsorted(self.places[lo:hi], base + row[is_new])
                to[slot], prefix[slot] = target[is_new], value[is_new]
                after.append(target[~is_new])
                after_prefix.append(value[~is_new])
                tail = order[group[present] + here[present] - 1]
                least = np.minimum(least, p.min())
                least[present] = least_of(tail + 1, np.full(len(tail), len(b) - 1))
                last_new[present] = new[tail]
                seen += here
        return to, prefix, (np.concatenate(after), np.concatenate(after_prefix))

    def _merge(self, to: np.ndarray, symbols: np.ndarray, prefix: np.ndarray,
               after: np.ndarray, after_prefix: np.ndarray) -> None:
        """Write the file of this round: the old rows in their order, new ones at ``to``, prefixes of ``after`` set."""
        by_row = np.argsort(to)
        to, symbols, prefix = to[by_row], symbols[by_row], prefix[by_row]
        by_row = np.argsort(after)
        after, after_prefix = after[by_row], after_prefix[by_row]
        new = symbols.astype(np.uint16) << 8 | prefix
        rows, old = self.rows + len(to), self.round - 1
        with self._in(old) as before, self._out(self.round) as out:
            for base in range(0, rows, self.chunk):
                size = min(self.chunk, rows - base)
                lo, hi = np.searchsorted(to, [base, base + size])
                stays = np.ones(size, bool)
                stays[to[lo:hi] - base] = False
                both = np.empty(size, np.uint16)
                both[stays] = np.frombuffer(before.read(2 * (size - (hi - lo))), np.uint16)
                both[to[lo:hi] - base] = new[lo:hi]
                lo, hi = np.searchsorted(after, [base, base + size])
                at = after[lo:hi] - base
                both[at] = both[at] & 0xFF00 | after_prefix[lo:hi]
                out.write(both.data)
        self.store.delete_file(self._path(old))
        self.rows = rows

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The transform and the common prefixes of the suffixes inserted so far."""
        with self._in(self.round) as rows:
            both = np.frombuffer(rows.read(2 * self.rows), np.uint16)
        return (both >> 8).astype(np.uint8), both.astype(np.uint8)

    def repeated_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, class) of every stretch of ``cap`` symbols; equal ones, and only these, are
        of one class. Walks all strings back through the transform, one symbol per round."""
        bwt, lcp = self.sequences()
        classes = np.cumsum(lcp < self.cap)
        n = len(self.sizes)
        order = np.argsort(bwt, kind="stable")[:self.rows - n]
        step = np.zeros(self.rows, np.int64)
        step[order] = np.arange(n, self.rows)
        del order
        string, row, found = np.arange(n), np.arange(n), []
        for size in range(1, int(self.sizes.max(initial=0)) + 1):
            more = self.sizes[string] >= size
            string, row = string[more], step[row[more]]
            if size >= self.cap:
                found.append((string, self.sizes[string] - size, classes[row]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))
