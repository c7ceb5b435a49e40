import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.stats import (
    equal_width_bins, exact_percentiles, global_row_number, rank_quartile_score,
)


def _pct(values, probs):
    return [float(np.quantile(np.asarray(values, dtype=float), p)) if len(values) else None for p in probs]


@pytest.mark.parametrize("values", [
    [], [5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0, 2.0, 9.0],
    list(np.random.default_rng(1).integers(0, 20, 997).astype(float)),
    list(np.round(np.random.default_rng(2).lognormal(8, 1.2, 5000), 2)),
])
def test_exact_percentiles_match_linear_interpolation(spark, values):
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    want = _pct(values, probs)
    for got in (exact_percentiles(df, "x", probs).first(),
                exact_percentiles(df.repartition(5), "x", probs).first()):
        for g, w in zip(got, want):
            if w is None:
                assert g is None
            else:
                assert g == pytest.approx(w, rel=1e-12, abs=1e-9)


def test_exact_percentiles_large_and_skewed(spark):
    rng = np.random.default_rng(9)
    vals = np.concatenate([np.full(20000, 42.0), np.round(rng.lognormal(5, 1, 40000), 2)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(8)
    probs = [0.1, 0.25, 1 / 3, 0.5, 0.75, 0.99]
    got = exact_percentiles(df, "x", probs).first()
    assert list(got) == pytest.approx(_pct(vals, probs), rel=1e-12)


def test_global_row_number_skewed(spark):
    rng = np.random.default_rng(3)
    freq = np.where(rng.random(3000) < 0.6, 1, rng.integers(1, 40, 3000))  # one hot value
    rows = [(f"C{i:05d}", int(f)) for i, f in enumerate(freq)]
    df = spark.createDataFrame(rows, "customer_id string, frequency long").repartition(7)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.customer_id: r.rn for r in global_row_number(df, ["frequency", "customer_id"]).collect()}
    assert [got[c] for c, _ in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("n,sizes", [(6, [2, 1, 1, 2]), (7, [2, 2, 1, 2]), (8, [2, 2, 2, 2]), (9, [3, 2, 2, 2])])
def test_rank_quartile_score_bucket_sizes(spark, n, sizes):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"))
    scores = [r.s for r in df.select(rank_quartile_score(F.col("rn"), F.lit(n)).alias("s")).collect()]
    assert [scores.count(s) for s in (1, 2, 3, 4)] == sizes
    # same as pandas qcut on ranks
    q = pd.qcut(pd.Series(range(1, n + 1)).rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    assert scores == list(q)


@pytest.mark.parametrize("values", [
    list(np.round(np.random.default_rng(4).gamma(2, 300, 2000), 2)),
    [7.0] * 10,
    [0.0, 1.0, 0.5, 0.25, 1.0],
])
def test_equal_width_bins_match_numpy(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    lo, hi = min(values), max(values)
    got = [r.b for r in df.select(equal_width_bins(F.col("x"), F.lit(lo), F.lit(hi), 50).alias("b")).collect()]
    counts = np.bincount(got, minlength=50)
    want, _ = np.histogram(np.asarray(values), bins=50)
    assert list(counts) == list(want)


def test_order_histogram_matches_numpy(spark):
    from ledgerlens.operators.eda import order_histogram
    rng = np.random.default_rng(11)
    vals = np.round(rng.gamma(2.0, 500.0, 3000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "revenue double")
    out = order_histogram(df).collect()
    cap = np.quantile(vals, 0.99)
    kept = vals[vals <= cap]
    want, edges = np.histogram(kept, bins=50)
    assert [r.orders for r in out] == list(want)
    assert [r.bin_lower for r in out] == pytest.approx(list(edges[:-1]), rel=1e-12)
    assert out[0].clip_value == pytest.approx(cap, rel=1e-12)
    assert out[0].median_value == pytest.approx(float(np.median(kept)), rel=1e-12)
    assert out[0].mean_value == pytest.approx(float(kept.mean()), rel=1e-9)


def test_order_histogram_of_nothing_and_of_one_value(spark):
    from ledgerlens.operators.eda import order_histogram
    assert order_histogram(spark.createDataFrame([(None,)], "revenue double")).collect() == []
    out = order_histogram(spark.createDataFrame([(7.0,)] * 5, "revenue double")).collect()
    assert len(out) == 50 and sum(r.orders for r in out) == 5
    assert (out[0].clip_value, out[0].mean_value, out[0].median_value) == (7.0, 7.0, 7.0)
