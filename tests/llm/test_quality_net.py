"""The quality network: held-out accuracy, word vectors against plain sums, defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_net as q
from ledgerlens.llm import queries
from ledgerlens.llm.common import majority_labels
from ledgerlens.llm.text_kernels import NO_FOLD, WORDS_AND_MARKS, token_hashes

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    rows = queries.op2_quality_classifier(spark, SF).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.93 and np.mean([s >= 0.3 for s in good]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = majority_labels(spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    turned = labels.withColumn("label", F.when(q.held_out(F.col("label_id")), 1 - F.col("label")).otherwise(F.col("label")))
    one, two = (q.train(docs, x.where(~q.held_out(F.col("label_id")))) for x in (labels, turned))
    assert np.allclose(one.scores(["some words here", None]), two.scores(["some words here", None]))


def test_word_vectors_are_the_summed_contexts(spark):
    texts = ["a b c a", "b b!! c", None, "", "solo"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    buckets, dims = 64, 8
    places, signs = q.index_vectors(buckets, dims)
    counts, sums = np.zeros(buckets, int), np.zeros((buckets, dims), int)
    for t in texts:
        _, hashes, _ = next(token_hashes([t], WORDS_AND_MARKS, NO_FOLD))
        tokens = (hashes >> np.uint64(58)).astype(int)
        for i, w in enumerate(tokens):
            counts[w] += 1
            for j in range(max(0, i - q.REACH), min(len(tokens), i + q.REACH + 1)):
                if j != i:
                    for p, s in zip(places[tokens[j]], signs[tokens[j]]):
                        sums[w, p] += s
    got = {r[0]: tuple(r)[1:] for r in q.word_vectors(df, buckets, dims).collect()}
    assert got == {w: (counts[w], *sums[w]) for w in np.flatnonzero(counts)}


def test_calibration_and_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    p = q.fit(x, y).probabilities(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (p >= low) & (p < low + 0.25)
        assert abs(p[part].mean() - y[part].mean()) < 0.08


@pytest.mark.parametrize("labels,score", [([], 1.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_one_sided_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame(labels, "label_id long, label int"))
    assert [r.score for r in q.scored(docs, model).collect()] == pytest.approx([score] * 3, abs=1e-5)


def test_defined_cases(spark):
    rows = [(1, "good words here", 7, "x"), (1, "good words here", 7, "x"), (None, None, 8, "y"), (3, "", 9, None),
            (4, "###", 9, None), (5, "x" * 200000, 1, "z"), (6, "w " * 100000, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, n string")
    labels = majority_labels(spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (5, None), (6, 0)],
                                                   "doc_id long, quality int"), "quality")
    out = q.scored(docs, q.train(docs, labels))
    assert out.columns == ["doc_id", "text", "label", "n", "score"]
    got = out.collect()
    assert sorted(tuple(r)[:4] for r in got if r.doc_id) == sorted(r for r in rows if r[0])
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    empty = docs.where("false")
    assert q.scored(empty, q.train(empty, labels)).collect() == []


def test_pooling_by_hand():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(64, 4)).astype(np.float32)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    weight = rng.random(64).astype(np.float32)
    texts = ["a b c", None, "solo", "r r r r", "", "x!! y"]
    got = q.pool(texts, table, weight)
    for text, row in zip(texts, got):
        tokens = [] if not text else (next(token_hashes([text], WORDS_AND_MARKS, NO_FOLD))[1] >> np.uint64(58)).astype(int)
        if not len(tokens):
            assert not row.any()
            continue
        mean = sum(weight[t] * table[t] for t in tokens) / sum(weight[t] for t in tokens)
        pairs = [float(table[s] @ table[t]) for s, t in zip(tokens, tokens[1:])]
        assert row == pytest.approx([*mean, np.linalg.norm(mean), np.mean(pairs) if pairs else 0], abs=1e-5)
