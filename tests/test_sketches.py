"""Percentiles from mergeable sketches: rank errors, merging, one scan and nothing written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import eda, rfm, stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def values(seed, n=40_000):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.full(n // 3, 42.0), np.round(rng.lognormal(5, 2, n - n // 3), 2)])


def off(sorted_values, x, p):
    """How far the ranks that ``x`` takes are from ``p``."""
    lo, hi = (np.searchsorted(sorted_values, x, side) / len(sorted_values) for side in ("left", "right"))
    return max(0.0, lo - p, p - hi)


@pytest.mark.parametrize("accuracy", [0.02, 0.002])
def test_ranks_are_within_the_accuracy(spark, accuracy):
    v = values(3)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double").repartition(9)
    got = stats.approx_percentiles(df, [("x", p) for p in PROBS], accuracy).first()
    v.sort()
    assert [off(v, x, p) <= accuracy for x, p in zip(got, PROBS)] == [True] * len(PROBS)
    assert set(got) <= set(v)


def test_sketches_merge_by_fewer_keys(spark):
    v = values(4)
    df = spark.createDataFrame([(float(x), i % 20, i % 3) for i, x in enumerate(v)], "x double, a int, b int")
    parts = stats.value_sketches(df, ["x"], 0.01, ["a", "b"])
    assert parts.count() == 60
    for by in (["b"], []):
        for r in stats.merged_sketches(parts, ["x"], 0.01, by).select(
                *by, *[stats.sketched_quantile(F.col("sketch_x"), p).alias(f"q{i}") for i, p in enumerate(PROBS)]).collect():
            own = np.sort(v[np.arange(len(v)) % 3 == r.b]) if by else np.sort(v)
            assert all(off(own, r[f"q{i}"], p) <= 0.01 for i, p in enumerate(PROBS))


def test_scores_by_sketch_scan_once_and_write_nothing(spark, monkeypatch, tmp_path):
    rows = [(f"C{i:05d}", i % 50, 1 + i % 9, float(i * 37 % 5000)) for i in range(5000)]
    spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary double").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    monkeypatch.setattr("ledgerlens.sources.files.checkpoint_table", None)
    scored = rfm.quantile_score(v, accuracy=0.01)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("FileScan") <= 3          # scores, and the edges' subquery
    counts = [r["count"] / 5000 for r in scored.groupBy("score").count().collect()]
    assert len(counts) == 4 and all(abs(c - 0.25) <= 0.02 for c in counts)


def test_segments_by_sketch_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(f"C{i:05d}", int(a), int(f), float(m)) for i, (a, f, m) in enumerate(
        zip(rng.integers(1, 900, 4000), rng.geometric(0.1, 4000), np.round(rng.lognormal(6, 1, 4000), 2)))]
    v = spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary double")
    exact = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in rfm.rfm_scores(v).collect()}
    near = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in rfm.rfm_scores(v, accuracy=0.002).collect()}
    assert sum(exact[c] != near[c] for c in exact) <= 0.002 * 6 * 2 * len(exact)
    assert all(exact[c][1] == near[c][1] for c in exact)


def test_histogram_by_sketch(spark):
    v = np.round(np.random.default_rng(11).gamma(2.0, 500.0, 30_000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "revenue double").repartition(5)
    got, want = eda.order_histogram_sketch(df, 0.002).collect(), eda.order_histogram(df).collect()
    assert [r.bin for r in got] == list(range(50)) and got[0].__fields__ == want[0].__fields__
    assert got[0].clip_value == pytest.approx(want[0].clip_value, rel=0.02)
    assert got[0].median_value == pytest.approx(want[0].median_value, rel=0.01)
    assert got[0].mean_value == pytest.approx(want[0].mean_value, rel=0.01)
    for r in got:
        exact = ((v >= r.bin_lower) & (v < r.bin_upper)).sum()
        assert abs(r.orders - exact) <= 3 * 0.002 * len(v) + 2
    plan = eda.order_histogram_sketch(df, 0.002)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_nothing_and_bad_accuracies(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "revenue double")
    assert stats.approx_percentiles(none, [("revenue", 0.5)], 0.01).first()[0] is None
    assert eda.order_histogram_sketch(none, 0.01).collect() == []
    for bad in (0, 1, 1e-9):
        with pytest.raises(ValueError, match="accuracy|largest"):
            stats.sketch_size(bad)
