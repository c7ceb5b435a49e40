"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words and runs of punctuation are hashed into ``buckets``. Every bucket has a
sparse random index vector (a few +1 and -1, from the bucket's number); a
bucket's word vector is the sum of the index vectors of its neighbours, over all
tokens of all documents. A document is the mean of its tokens' unit vectors,
weighted by a / (a + p) with the bucket's corpus frequency p, the length of that
mean, and the mean similarity of neighbouring tokens' vectors. A network of two
layers in numpy is fitted on a bounded sample of labelled documents
(``max_train``, the smallest hashes of their ids), its probabilities are
calibrated by a temperature on a part of the sample that it was not fitted on.

The corpus pass counts everything: each task keeps one table of ``buckets`` x
``dims`` sums and hands on its rows, which Spark adds up. The tables that tasks
receive have that fixed size too.

Defined cases: null, empty and blank texts pool to the zero vector and get its
score; labels that contradict each other count by majority (ties good), null
labels are ignored; repeated rows are scored each; without both labels in the
sample every document scores the share of good ones (1 without labels); an empty
table gives an empty result; other columns pass through ``scored`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .text_kernels import NO_FOLD, WORDS_AND_MARKS, give_back, token_hashes

BUCKETS = 1 << 13
DIMS = 32
NONZERO = 4
REACH = 2
EXTRA = 2
MAX_TRAIN = 20_000
HIDDEN = 24
EPOCHS = 30
RATE = 0.005
DECAY = 1e-3
SMOOTH = 1e-2
SEED = 11
#: Documents with at least this probability of being good are accepted.
ACCEPT = 0.3


def index_vectors(buckets: int, dims: int, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, dims, (buckets, nonzero)), rng.choice(np.array([-1, 1], np.int64), (buckets, nonzero))


def _tokens(texts: list[str | None], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for first, hashes, bounds in token_hashes(texts, WORDS_AND_MARKS, NO_FOLD):
        yield first, (hashes >> shift).astype(np.int64), bounds


def word_vectors(docs: DataFrame, buckets: int = BUCKETS, dims: int = DIMS, reach: int = REACH) -> DataFrame:
    """(bucket, n, v0 .. v<dims-1>): token count and summed context of every bucket, over all texts."""
    names = [f"v{i}" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(buckets, dims)
        total, counts = np.zeros(buckets * dims, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, tokens, bounds in _tokens(batch["text"].to_pylist(), buckets):
                counts += np.bincount(tokens, minlength=buckets)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, reach + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = tokens[:-step][near], tokens[step:][near]
                    for k in range(places.shape[1]):
                        for word, context in ((left, right), (right, left)):
                            total += np.bincount(word * dims + places[context, k], signs[context, k],
                                                 buckets * dims).astype(np.int64)
        seen = np.flatnonzero(counts)
        table = total.reshape(buckets, dims)[seen]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), *[pa.array(c) for c in table.T]],
                                         ["bucket", "n", *names])
        give_back()

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in ("bucket", "n", *names)))
    sums = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return written(sums, "word-vectors")


def pooling_table(vectors: DataFrame, buckets: int = BUCKETS, dims: int = DIMS, smooth: float = SMOOTH
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, weights) by bucket, from at most ``buckets`` rows."""
    rows = np.array([tuple(r) for r in vectors.collect()], np.float64).reshape(-1, dims + 2)
    table, weight = np.zeros((buckets, dims), np.float32), np.zeros(buckets, np.float32)
    if len(rows):
        at, n = rows[:, 0].astype(int), rows[:, 1]
        centred = rows[:, 2:] / n[:, None]
        centred = centred - (centred * n[:, None]).sum(0) / n.sum()
        table[at] = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
        weight[at] = smooth / (smooth + n / n.sum())
    return table, weight


def pool(texts: list[str | None], table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row per text: the weighted mean of its tokens' vectors, that mean's length (long
    where few different tokens make up the text), and the mean similarity of neighbouring
    tokens (1 where a token repeats)."""
    out = np.zeros((len(texts), table.shape[1] + EXTRA), np.float32)
    weighted = table * weight[:, None]
    for first, tokens, bounds in _tokens(texts, len(table)):
        if not len(tokens):
            continue
        own = slice(first, first + len(bounds) - 1)
        a, b = bounds[:-1], bounds[1:]

        def summed(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            sums = np.cumsum(values, axis=0, dtype=np.float64)
            sums = np.concatenate([np.zeros((1, *sums.shape[1:])), sums])
            return sums[end] - sums[begin]

        mean = summed(weighted[tokens], a, b) / np.maximum(summed(weight[tokens], a, b), 1e-9)[:, None]
        alike = (table[tokens[:-1]] * table[tokens[1:]]).sum(1)
        pairs = np.maximum(b - a - 1, 0)
        out[own, :-EXTRA] = mean
        out[own, -2] = np.linalg.norm(mean, axis=1)
        start = np.minimum(a, len(alike))
        out[own, -1] = summed(alike, start, start + pairs) / np.maximum(pairs, 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _constant(share: float, dims: int) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1),
                   float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE) -> Network:
    """Adam on the cross entropy over four fifths of the rows, temperature on the rest."""
    if len(y) == 0 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 1.0, x.shape[1])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held = order[:max(1, len(y) // 5)]
    own = order[len(held):] if len(y) > 5 else order
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, turn = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        rows = rng.permutation(own)
        for at in range(0, len(rows), 256):
            k = rows[at:at + 256]
            h = np.tanh(z[k] @ p[0] + p[1])
            out = h @ p[2] + p[3]
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[k]) / len(k)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[k].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            turn += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.999**turn)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, truth = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        s = np.clip(logits / t, -30, 30)
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    net.temperature = min(np.geomspace(0.5, 5, 46).tolist(), key=loss)
    return net


@dataclass
class Model:
    table: np.ndarray
    weight: np.ndarray
    network: Network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.network.probabilities(pool(texts, self.table, self.weight))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, dims: int = DIMS) -> Model:
    """Word vectors from all of ``docs``, the network from at most ``max_train`` of the ``labels``
    (label_id, label): those with the smallest hashes, so the choice does not depend on order."""
    table, weight = pooling_table(word_vectors(docs, buckets, dims), buckets, dims)
    sample = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch["text"].to_pylist(), table, weight)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["label"], pa.array(list(x))],
                                             ["id", "label", "x"])
        give_back()

    pooled = rows.select("doc_id", "label", "text").mapInArrow(run, "id string, label int, x array<float>")
    got = sorted(pooled.groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect())
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), dims + EXTRA)
    return Model(table, weight, fit(x, np.array([r["label"] for r in got], np.float64)))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the calibrated probability of a good document.
    The text and all other columns stay where they are; nothing is shuffled."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_names.index("text")
        for batch in batches:
            scores = model.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.astype(np.float64))], [*docs_names, name])
        give_back()

    docs_names = docs.columns
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows never learnt from: CRC-32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
