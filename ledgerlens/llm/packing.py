"""Best-fit packing of token sequences by a configuration linear program.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Only
the histogram of piece lengths (``capacity`` numbers at most) goes to the driver.
There a linear program over configurations (multisets of lengths that fit one
sequence) is solved by multiplicative weights: lengths covered ahead of schedule
get cheaper, lengths behind dearer, and knapsack dynamic programming prices the
best filling for every length at once. The fractional solution is rounded down;
what remains is packed best-fit decreasing, still on the histogram, by groups of
equal sequences. Should best-fit decreasing alone need fewer sequences (it can on
histograms of a few long lengths, where the weights converge slowly), its
configurations are taken. Each configuration so names, for a length, an interval of ranks,
and every piece finds its sequence and offset from its rank within its length.
Ranks come from per-task counters and their offsets: no length is ever gathered
in one task, however many pieces share it.

Defined cases: null and empty texts are one closing token; ties of length take
any order; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .text_kernels import give_back
from .tokens import encoder, slices

CAPACITY = 2048
TURNS = 60
RATE = 4.0

Pattern = tuple[tuple[int, int], ...]           # ((length, times), ...), longest first


def encoded_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): ``nth`` counts pieces of that length in the task."""
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType())] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")] + [
        T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer_path), [0] * (capacity + 1)
        closing = np.asarray([closing_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids, bounds = enc.encode(part["text"])
                data, row, piece, start, length, crc, nth = ids.tobytes(), [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    whole = data[4 * a:4 * b] + closing
                    for k, at in enumerate(range(0, b - a + 1, capacity)):
                        own = whole[4 * at:4 * (at + capacity)]
                        size = len(own) // 4
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                    [f.name for f in fields])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest value that fits into c; choice[c]: a length taken there, 0 for none."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]) if len(sizes) else capacity + 1, capacity + 1):
        k = upto[c]
        gain = best[c - sizes[:k]] + value[:k]
        i = int(gain.argmax())
        best[c], choice[c] = gain[i], sizes[i]
    return best, choice


def filling(choice: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and choice[room]:
        out.append(int(choice[room]))
        room -= out[-1]
    return out


def fractional(demand: np.ndarray, capacity: int, turns: int = TURNS, rate: float = RATE) -> dict[Pattern, float]:
    """Configuration -> times used (fractions), covering ``demand`` (by length, index 0 unused)."""
    sizes = np.flatnonzero(demand)
    wanted = demand[sizes].astype(float)
    at = np.zeros(capacity + 1, np.int64)
    at[sizes] = np.arange(len(sizes))
    covered = np.zeros(len(sizes))
    solution: dict[Pattern, float] = {}
    for turn in range(1, turns + 1):
        due = turn / turns
        weight = np.exp(-rate * np.clip(covered / wanted - due, -1, 1))
        _, choice = knapsack(sizes, sizes * weight, capacity)
        for i in range(len(sizes) - 1, -1, -1):                  # longest first, its best filling with it
            need = due * wanted[i] - covered[i]
            if need <= 1e-9:
                continue
            items = Counter([int(sizes[i]), *filling(choice, capacity - int(sizes[i]))])
            where = at[list(items)]
            times = np.fromiter(items.values(), float)
            used = need / times[list(items).index(int(sizes[i]))]
            pattern = tuple(sorted(items.items(), reverse=True))
            solution[pattern] = solution.get(pattern, 0.0) + used
            covered[where] += used * times
    return solution


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: groups of equally filled sequences take one piece each."""
    rooms: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        room = size
        while n and room < capacity:
            if not rooms[room]:
                room += 1
                continue
            content, count = rooms[room].pop()
            taken = min(n, count)
            if taken < count:
                rooms[room].append((content, count - taken))
            fit = min(room // size, max(1, n // taken))
            rooms[room - fit * size].append(({**content, size: content.get(size, 0) + fit}, taken))
            n -= taken * fit
        each = capacity // size
        if n >= each:
            rooms[capacity - each * size].append(({size: each}, n // each))
        if n % each:
            rooms[capacity - n % each * size].append(({size: n % each}, 1))
    return [(tuple(sorted(content.items(), reverse=True)), count) for group in rooms for content, count in group]


def configurations(counts: np.ndarray, capacity: int = CAPACITY, turns: int = TURNS,
                   rate: float = RATE) -> list[tuple[Pattern, int]]:
    """(configuration, number of sequences) that hold exactly ``counts`` pieces of each length."""
    left = np.array(counts, np.int64)
    greedy = best_fit(left, capacity)
    out: Counter = Counter()
    solution = fractional(left, capacity, turns, rate) if left.any() else {}
    fill = {p: sum(s * n for s, n in p) for p in solution}
    for pattern in sorted(solution, key=lambda p: (-fill[p], p)):
        n = min(int(solution[pattern] + 1e-6), *[int(left[s]) // k for s, k in pattern])
        if n > 0:
            out[pattern] += n
            for s, k in pattern:
                left[s] -= n * k
    for pattern, n in best_fit(left, capacity):
        out[pattern] += n
    return sorted(out.items() if sum(out.values()) <= sum(n for _, n in greedy) else greedy)


def slots(packed: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by first rank: (first rank, first sequence, times, offset in the sequence)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, n in packed:
        offset = 0
        for size, times in pattern:
            rows.setdefault(size, []).append((taken[size], sequence, times, offset))
            taken[size] += n * times
            offset += size * times
        sequence += n
    return {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, turns: int = TURNS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(encoded_pieces(docs, tokenizer_path, capacity), "pieces")
    per_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():          # capacity rows at most
        counts[row["length"]] = row["n"]
    places = slots(configurations(counts, capacity, turns))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), len(order)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                rows = order[a:b]
                size = int(length[rows[0]])
                first, sequences, times, offsets_ = places[size]
                k = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[k]
                sequence[rows] = sequences[k] + nth // times[k]
                offset[rows] = offsets_[k] + nth % times[k] * size
            keep = [f.name for f in schema][:-2]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
