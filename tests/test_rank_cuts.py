"""Frequency scores from counts, relative rounding of the trend, and plans that start no job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import significant
from ledgerlens.operators import forecast, kpi, rfm
from ledgerlens.operators.stats import rank_quartile_score
from ledgerlens.plans import queries as Q

SF = "/root/testdata/sf0.001"
VALUES = "customer_id string, recency int, frequency long, monetary double"


def customers(frequencies):
    return [(f"C{(i * 7919) % 100_003:06d}", i % 50, int(f), float(i % 17)) for i, f in enumerate(frequencies)]


@pytest.mark.parametrize("frequencies", [
    [], [3], [1, 1], [1, 2, 3], [5] * 7, list(range(1, 10)), [1] * 6 + [2, 3], [1] + [9] * 11,
    list(np.random.default_rng(1).integers(1, 6, 501)), [1] * 400 + list(range(2, 102)),
    list(np.random.default_rng(2).geometric(0.02, 1000))])
def test_frequency_scores_equal_those_of_the_ranks(spark, frequencies):
    df = spark.createDataFrame(customers(frequencies), VALUES).repartition(5)
    ranked = rfm.rank_first(df)
    want = {r.customer_id: r.s for r in ranked.select(
        "customer_id", rank_quartile_score(F.col("f_rank"), F.lit(len(frequencies))).alias("s")).collect()}
    assert {r.customer_id: r.f_score for r in rfm.rfm_scores(df).collect()} == want
    assert len(want) == len(frequencies)


def test_only_customers_of_cut_frequencies_are_put_in_order(spark, monkeypatch):
    ordered = []
    inner = rfm.range_numbered
    monkeypatch.setattr(rfm, "range_numbered", lambda df, cols, name: ordered.append(df) or inner(df, cols, name))
    freq = [1] * 250 + [2] * 260 + list(range(3, 493))          # edges inside 1 and 2, and between others
    scored = rfm.rfm_scores(spark.createDataFrame(customers(freq), VALUES))
    assert sorted(r.frequency for r in ordered[0].select("frequency").distinct().collect()) in ([1, 2], [2], [1])
    assert len(scored.collect()) == 1000
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(frequency" not in plan


def test_facts_are_aggregated_once_for_the_segments(spark, monkeypatch):
    seen = []
    inner = rfm.checkpoint_table
    monkeypatch.setattr(rfm, "checkpoint_table", lambda df, name: seen.append(name) or inner(df, name))
    rfm.compute_rfm(Q.sales(spark, SF))
    assert seen == ["rfm_customers"]


@pytest.mark.parametrize("x, digits, want", [
    (1234567.0, 3, 1230000.0), (1.23456e-7, 3, 1.23e-7), (-0.00012345, 2, -0.00012), (0.0, 5, 0.0), (999.6, 3, 1000.0),
    (5e300, 2, 5e300), (None, 3, None)])
def test_significant_digits(spark, x, digits, want):
    got = spark.createDataFrame([(x,)], "x double").select(significant("x", digits)).first()[0]
    assert got == (None if want is None else pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9])
def test_trends_of_any_size_are_fitted_alike(spark, scale):
    rows = [(f"{2020 + i // 12}-{i % 12 + 1:02d}-01", (2.5e-4 + 1.4e-6 * i) * scale) for i in range(36)]
    fit = forecast.fit_trend(spark.createDataFrame(rows, "ds string, trend double")).first()
    assert fit.slope == pytest.approx(1.4e-6 * scale, rel=1e-8)
    assert fit.intercept == pytest.approx(2.5e-4 * scale, rel=1e-8)


def test_kpi_plans_start_no_job(spark):
    sales = Q.sales(spark, SF)
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        k = kpi.compute_kpis(sales, 3)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert k.first().order_count > 0


def test_a_heatmap_has_a_bound(spark, monkeypatch):
    from ledgerlens.operators import eda
    monkeypatch.setattr(eda, "MAX_REGIONS", 2)
    df = spark.createDataFrame([(1, "Jan", r, 1.0) for r in "abc"], "month int, month_name string, region string, revenue double")
    with pytest.raises(ValueError, match="regions"):
        eda.heatmap_data(df)
    assert eda.heatmap_data(df, ["a", "c"]).columns == ["month", "month_name", "a", "c"]
