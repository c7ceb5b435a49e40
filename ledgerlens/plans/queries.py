"""The registered queries: each reads the star schema under ``sf_dir`` and
returns one report DataFrame. Keys match ``plans.oracle.Q``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import clean, eda
from ledgerlens.plans.materialize import materialized, materialized_path
from ledgerlens.sources.tables import sales_by_year, sales_from_star


def build_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed sales from the star schema, with the engineered features (lazy)."""
    return clean.engineer_features(sales_from_star(spark, sf_dir))


def build_sales_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``build_sales``, sorted by year inside partitions before the texts are made."""
    df = clean.engineer_features(sales_by_year(spark, sf_dir))
    # the year that rows are sorted by, so that the writer need not sort whole rows again
    return df.withColumn("year", F.col("_year")).drop("_year")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table, built once per session and read back from parquet
    (partitioned by year: year filters prune folders)."""
    return materialized(spark, "sales", sf_dir, build_sales_by_year, partition_by="year", rebalance=False)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@register("region_performance")
def q_region_performance(spark, sf_dir):
    return eda.region_performance(sales(spark, sf_dir))


FILTER_YEARS = [1996, 1998, 2000]
FILTER_REGIONS = ["AMERICA", "ASIA", "EUROPE"]
FILTER_CATEGORIES = ["Economy", "Large", "Promo"]


def filtered(spark, sf_dir):
    return clean.filter_sales(sales(spark, sf_dir), FILTER_YEARS, FILTER_REGIONS, FILTER_CATEGORIES)


def _simple(name, fn):
    register(name)(lambda spark, sf_dir: fn(sales(spark, sf_dir)))


for _name, _fn in [
    ("summary_stats", eda.summary_stats),
    ("filter_options", clean.filter_options),
    ("monthly_sales_trend", eda.monthly_sales_trend),
    ("yoy_growth", eda.yoy_growth),
    ("top_products", eda.top_products),
    ("bottom_products", eda.bottom_products),
    ("category_performance", eda.category_performance),
    ("city_performance", eda.city_performance),
    ("top_customers", eda.top_customers),
    ("segment_analysis", eda.segment_analysis),
    ("monthly_avg_revenue", eda.monthly_avg_revenue),
    ("heatmap_data", eda.heatmap_data),
    ("discount_impact", eda.discount_impact),
    ("order_value_distribution", eda.order_value_distribution),
    ("order_histogram", eda.order_histogram),
    ("customer_concentration", eda.customer_concentration),
]:
    _simple(_name, _fn)


@register("filter_sales")
def q_filter_sales(spark, sf_dir):
    return filtered(spark, sf_dir)


@register("overview_cards")
def q_overview_cards(spark, sf_dir):
    return eda.overview_cards(filtered(spark, sf_dir))


# --- RFM ------------------------------------------------------------------
from ledgerlens.operators import rfm as _rfm  # noqa: E402
from ledgerlens.operators.stats import top_n as _top_n, share_of_total as _share  # noqa: E402
from pyspark.sql import functions as _F  # noqa: E402


def rfm_table(spark, sf_dir):
    """Segmented customers, written once per session (reused by four reports)."""
    return materialized(spark, "rfm", sf_dir, lambda s, d: _rfm.compute_rfm(sales(s, d)))


@register("rfm_values")
def q_rfm_values(spark, sf_dir):
    return _rfm.rfm_values(sales(spark, sf_dir))


def rfm_values_table(spark, sf_dir):
    """Per-customer values, written once per session (input of the scoring queries)."""
    return materialized(spark, "rfm_values", sf_dir, lambda s, d: _rfm.rfm_values(sales(s, d)))


@register("rfm_scores")
def q_rfm_scores(spark, sf_dir):
    return _rfm.rfm_scores(rfm_values_table(spark, sf_dir))


@register("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return _rfm.compute_rfm(sales(spark, sf_dir))


@register("segment_summary")
def q_segment_summary(spark, sf_dir):
    return _rfm.segment_summary(rfm_table(spark, sf_dir))


@register("rfm_grid")
def q_rfm_grid(spark, sf_dir):
    return _rfm.rfm_grid(rfm_table(spark, sf_dir))


@register("rfm_scatter")
def q_rfm_scatter(spark, sf_dir):
    return _rfm.rfm_scatter(rfm_table(spark, sf_dir))


@register("segment_compare")
def q_segment_compare(spark, sf_dir):
    return _rfm.segment_compare(rfm_table(spark, sf_dir))


@register("rank_first")
def q_rank_first(spark, sf_dir):
    return _rfm.rank_first(rfm_values_table(spark, sf_dir)).select("customer_id", "frequency", "f_rank")


@register("quantile_score")
def q_quantile_score(spark, sf_dir):
    return _rfm.quantile_score(rfm_values_table(spark, sf_dir), "monetary")


@register("top_n")
def q_top_n(spark, sf_dir):
    g = (sales(spark, sf_dir).groupBy("customer_id")
         .agg(_F.count("order_id").alias("orders")))
    return _top_n(g, [_F.col("orders").desc(), _F.col("customer_id")], 15)


@register("share_of_total")
def q_share_of_total(spark, sf_dir):
    from ledgerlens.functions.exprs import money_sum
    g = sales(spark, sf_dir).groupBy("segment", "region").agg(money_sum("revenue").alias("revenue"))
    return _share(g, "revenue", "revenue_share", 6)


# --- forecast ---------------------------------------------------------------
from ledgerlens.operators import forecast as _fc  # noqa: E402
from ledgerlens.operators import kpi as _kpi  # noqa: E402
from ledgerlens.operators.stats import centered_moving_average as _cma  # noqa: E402


@register("monthly_series")
def q_monthly_series(spark, sf_dir):
    return _fc.monthly_series(sales(spark, sf_dir))


def series_table(spark, sf_dir):
    """The monthly revenue series, written once per session (one row per month)."""
    return materialized(spark, "monthly_series", sf_dir, lambda s, d: _fc.monthly_series(sales(s, d)))


@register("centered_moving_average")
def q_centered_moving_average(spark, sf_dir):
    return _cma(series_table(spark, sf_dir), "y", "ds", 12, 6, "trend")


@register("decompose")
def q_decompose(spark, sf_dir):
    return _fc.decompose(series_table(spark, sf_dir))


@register("seasonal_index")
def q_seasonal_index(spark, sf_dir):
    return _fc.seasonal_index(_fc.decompose(series_table(spark, sf_dir)))


@register("fit_trend")
def q_fit_trend(spark, sf_dir):
    return _fc.fit_trend(_fc.decompose(series_table(spark, sf_dir)))


@register("forecast")
def q_forecast(spark, sf_dir):
    return _fc.forecast(sales(spark, sf_dir), 6)


@register("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    return _fc.forecast_summary(_fc.forecast(sales(spark, sf_dir), 6))


# --- KPI --------------------------------------------------------------------
# Targets for the star-schema fixture (its revenue is far larger than the
# reference's sample), chosen so that all three statuses occur.
FIXTURE_TARGETS = {"monthly_revenue": 30_000_000.0, "avg_order_value": 45_000.0,
                   "profit_margin": 0.40, "order_count": 700.0, "discount_rate": 0.10}


@register("compute_kpis")
def q_compute_kpis(spark, sf_dir):
    return _kpi.compute_kpis(sales(spark, sf_dir), 3)


@register("classify_kpi")
def q_classify_kpi(spark, sf_dir):
    return _kpi.kpi_alerts(sales(spark, sf_dir), 3, FIXTURE_TARGETS).select(
        "key", "value", "target", "ratio", "status", "pct_vs_target")


@register("kpi_alerts")
def q_kpi_alerts(spark, sf_dir):
    return _kpi.kpi_alerts(sales(spark, sf_dir), 3, FIXTURE_TARGETS)


@register("kpi_alert_counts")
def q_kpi_alert_counts(spark, sf_dir):
    return _kpi.kpi_alert_counts(_kpi.kpi_alerts(sales(spark, sf_dir), 3, FIXTURE_TARGETS))


@register("rolling_kpi_window")
def q_rolling_kpi_window(spark, sf_dir):
    return _kpi.rolling_kpi_window(_kpi.monthly_kpi_parts(sales(spark, sf_dir)), 3)


@register("kpi_history")
def q_kpi_history(spark, sf_dir):
    return _kpi.kpi_history(sales(spark, sf_dir), FIXTURE_TARGETS)


# --- cleaning (dirty raw_sales derived from the star schema) ------------------
from ledgerlens.sources.files import read_sales_csv as _read_csv, write_clean as _write_clean  # noqa: E402
from ledgerlens.sources.load import load_audit as _load_audit, load_sales as _load_sales  # noqa: E402
from ledgerlens.sources.tables import raw_sales_from_star  # noqa: E402
from ledgerlens.session import scratch_path as _scratch, sized_shuffles as _sized_shuffles  # noqa: E402
from ledgerlens.plans.materialize import written_once as _written_once  # noqa: E402


def export_from_star(spark, sf_dir):
    """raw_sales with the messy header names 'Revenue ' and 'Profit' of the original export."""
    return (raw_sales_from_star(spark, sf_dir)
            .withColumnRenamed("revenue", "Revenue ").withColumnRenamed("profit", "Profit"))


def raw_csv_path(spark, sf_dir):
    """The export written once per session as header CSV."""
    def write(path):
        df = export_from_star(spark, sf_dir)
        with _sized_shuffles(df):
            df.write.options(
                header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)

    return _written_once(spark, "raw_sales_csv", sf_dir, write)


def ragged_csv_path(spark, sf_dir):
    """The export with lines that miss their last two fields or have one too many, by
    the order's key and line number."""
    def write(path):
        df = export_from_star(spark, sf_dir)
        key = _F.split("order_id", "-")
        key = key[1].cast("bigint") + key[2].cast("bigint")
        line = _F.to_csv(_F.struct(*[_F.col(f"`{c}`") for c in df.columns]))
        short = _F.to_csv(_F.struct(*[_F.col(f"`{c}`") for c in df.columns[:-2]]))
        line = _F.when(key % 37 == 5, short).when(key % 41 == 7, _F.concat(line, _F.lit(",stray"))).otherwise(line)
        # one column named like the whole header, with a delimiter and a quote that no line has
        with _sized_shuffles(df):
            df.select(line.alias(",".join(df.columns))).write.options(
                header=True, sep="\x01", quote="\x02", escapeQuotes=False, ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)

    return _written_once(spark, "ragged_sales_csv", sf_dir, write)


def raw(spark, sf_dir):
    return materialized(spark, "raw_sales", sf_dir, raw_sales_from_star)


@register("load_sales")
def q_load_sales(spark, sf_dir):
    return _load_sales(spark, raw_csv_path(spark, sf_dir)).rows


@register("load_ragged_sales")
def q_load_ragged_sales(spark, sf_dir):
    """Short lines are filled with nulls, lines with a stray field are left out."""
    return _load_sales(spark, ragged_csv_path(spark, sf_dir)).rows


@register("load_bad_rows")
def q_load_bad_rows(spark, sf_dir):
    bad = _load_sales(spark, ragged_csv_path(spark, sf_dir)).bad_rows
    return bad.select(_F.split("line", ",")[0].alias("order_id"), "fields", "expected")


@register("load_audit")
def q_load_audit(spark, sf_dir):
    """The cleaning audit of a ragged export, from its lines to its clean rows."""
    load = _load_sales(spark, ragged_csv_path(spark, sf_dir))
    return clean.cleaning_audit(load.rows, loading=_load_audit(load), by="fingerprint")


@register("standardize_columns")
def q_standardize_columns(spark, sf_dir):
    return clean.standardize_columns(_read_csv(spark, raw_csv_path(spark, sf_dir)))


@register("fix_dtypes")
def q_fix_dtypes(spark, sf_dir):
    return clean.fix_dtypes(clean.standardize_columns(raw(spark, sf_dir)))


@register("mode_value")
def q_mode_value(spark, sf_dir):
    return clean.mode_value(clean.fix_dtypes(raw(spark, sf_dir)), "segment")


@register("handle_missing")
def q_handle_missing(spark, sf_dir):
    return clean.handle_missing(clean.fix_dtypes(raw(spark, sf_dir)))


@register("remove_duplicates")
def q_remove_duplicates(spark, sf_dir):
    return clean.remove_duplicates(clean.handle_missing(clean.fix_dtypes(raw(spark, sf_dir))))


@register("remove_duplicates_by_fingerprint")
def q_remove_duplicates_by_fingerprint(spark, sf_dir):
    return clean.remove_duplicates(clean.handle_missing(clean.fix_dtypes(raw(spark, sf_dir))), by="fingerprint")


@register("fix_quality_issues")
def q_fix_quality_issues(spark, sf_dir):
    return clean.fix_quality_issues(
        clean.remove_duplicates(clean.handle_missing(clean.fix_dtypes(raw(spark, sf_dir)))))


@register("engineer_features")
def q_engineer_features(spark, sf_dir):
    return clean.engineer_features(sales_from_star(spark, sf_dir)).select(
        "order_id", "date", "year", "month", "month_name", "quarter", "year_month", "profit", "revenue",
        "profit_margin")


def clean_table(spark, sf_dir):
    """The cleaned table, written once per session (input of the reports on it)."""
    return materialized(spark, "clean_sales", sf_dir, lambda s, d: clean.clean_sales(raw(s, d), by="fingerprint"))


@register("clean_sales")
def q_clean_sales(spark, sf_dir):
    return clean.clean_sales(raw(spark, sf_dir))


@register("data_quality_report")
def q_data_quality_report(spark, sf_dir):
    return clean.data_quality_report(clean_table(spark, sf_dir))


@register("cleaning_audit")
def q_cleaning_audit(spark, sf_dir):
    return clean.cleaning_audit(raw(spark, sf_dir), by="fingerprint")


@register("write_clean")
def q_write_clean(spark, sf_dir):
    path = _write_clean(clean_table(spark, sf_dir), _scratch(spark, "sales_clean"), "parquet", "year")
    return spark.read.parquet(path)


@register("rewrite_years")
def q_rewrite_years(spark, sf_dir):
    """The clean table after a first run with wrong profits in two years, and a second run of these years."""
    t = clean_table(spark, sf_dir)
    years = _F.col("year").isin(1996, 1997)
    path = _write_clean(t.withColumn("profit", _F.when(years, 0.0).otherwise(_F.col("profit"))),
                        _scratch(spark, "sales_clean"), sort_by=["region", "date"])
    _write_clean(t.where(years), path, touched_only=True, sort_by=["region", "date"])
    return spark.read.parquet(path)


# --- insights and the written report ---------------------------------------------
from ledgerlens.operators import insights as _ins  # noqa: E402
from ledgerlens.sources.files import write_report as _write_report  # noqa: E402


@register("insights")
def q_insights(spark, sf_dir):
    return _ins.insights(sales(spark, sf_dir))


@register("insight_text")
def q_insight_text(spark, sf_dir):
    return _ins.insight_text(_ins.insights(sales(spark, sf_dir)))


@register("write_report")
def q_write_report(spark, sf_dir):
    """Write the report tables, read them back, hand on every value as
    (table_name, key, measure, value)."""
    s = sales(spark, sf_dir)
    paths = _write_report({"insights": _ins.insights(s), "summary_stats": eda.summary_stats(s),
                           "discount_impact": eda.discount_impact(s)}, _scratch(spark, "report"))
    measures = {"insights": ("name", ["value", "value2"]),
                "summary_stats": ("top_region", ["total_revenue", "total_profit", "total_orders", "unique_customers"]),
                "discount_impact": ("discount_tier", ["avg_margin", "avg_revenue", "orders"])}
    out = None
    for name, (key, columns) in measures.items():
        values = _F.array(*[_F.struct(_F.lit(c).alias("measure"), _F.col(c).cast("double").alias("value"))
                            for c in columns])
        part = spark.read.parquet(paths[name]).select(
            _F.lit(name).alias("table_name"), _F.col(key).alias("key"), _F.explode(values).alias("v")).select(
            "table_name", "key", "v.*")
        out = part if out is None else out.unionByName(part)
    return out


# --- streaming ------------------------------------------------------------------
from ledgerlens.streaming import kpi_stream as _ks  # noqa: E402


@register("kpi_history_stream")
def q_kpi_history_stream(spark, sf_dir):
    """KPI history from monthly parts maintained by a streaming aggregation over
    the written sales files (one availableNow run)."""
    s = sales(spark, sf_dir)
    src = materialized_path(spark, "sales", sf_dir)
    parts_dir, ckpt = _scratch(spark, "kpi_parts"), _scratch(spark, "kpi_parts_ckpt")
    _ks.update_monthly_parts(spark, src, s.schema, parts_dir, ckpt)
    return _ks.kpi_history_from_parts(_ks.read_monthly_parts(spark, parts_dir), FIXTURE_TARGETS)


# --- dashboard flow: every report recomputed on the filtered rows ---------------------


@register("filtered_segment_summary")
def q_filtered_segment_summary(spark, sf_dir):
    return _rfm.segment_summary(_rfm.compute_rfm(filtered(spark, sf_dir)))


@register("filtered_forecast_summary")
def q_filtered_forecast_summary(spark, sf_dir):
    return _fc.forecast_summary(_fc.forecast(filtered(spark, sf_dir), 6))


@register("filtered_kpi_alerts")
def q_filtered_kpi_alerts(spark, sf_dir):
    return _kpi.kpi_alerts(filtered(spark, sf_dir), 3, FIXTURE_TARGETS)


@register("kpi_display")
def q_kpi_display(spark, sf_dir):
    return _kpi.kpi_display(_kpi.kpi_alerts(sales(spark, sf_dir), 3, FIXTURE_TARGETS))


# --- reports from the cube (no fact file is read) ---------------------------------------
from ledgerlens.operators import cube as _cube  # noqa: E402


def cube_table(spark, sf_dir):
    """The cube of the sales, written once per session."""
    path = _written_once(spark, "cube", sf_dir, lambda p: _cube.build_cube(sales(spark, sf_dir), p))
    return _cube.read_cube(spark, path)


def filtered_cube(spark, sf_dir):
    return _cube.filter_cube(cube_table(spark, sf_dir), FILTER_YEARS, FILTER_REGIONS, FILTER_CATEGORIES)


for _name, _fn in [
    ("cube_summary_stats", _cube.summary_stats),
    ("cube_region_performance", _cube.region_performance),
    ("cube_segment_analysis", _cube.segment_analysis),
    ("cube_category_performance", _cube.category_performance),
    ("cube_city_performance", _cube.city_performance),
    ("cube_heatmap_data", _cube.heatmap_data),
    ("cube_discount_impact", _cube.discount_impact),
]:
    register(_name)(lambda spark, sf_dir, fn=_fn: fn(cube_table(spark, sf_dir)))

for _name, _fn in [
    ("cube_filtered_overview_cards", _cube.overview_cards),
    ("cube_filtered_monthly_trend", _cube.monthly_sales_trend),
    ("cube_filtered_segment_analysis", _cube.segment_analysis),
]:
    register(_name)(lambda spark, sf_dir, fn=_fn: fn(filtered_cube(spark, sf_dir)))


@register("sketched_customers")
def q_sketched_customers(spark, sf_dir):
    """Distinct customers per region from merged sketches, held against the exact sets."""
    s = sales(spark, sf_dir)
    sketched = _cube.distinct_customers(_cube.customer_sets(s, form="sketch"), "region")
    exact = _cube.distinct_customers(cube_table(spark, sf_dir).customers, "region")
    near = _F.abs(_F.col("sketched") - _F.col("customers")) <= 0.05 * _F.col("customers")
    return exact.join(sketched.withColumnRenamed("customers", "sketched"), "region").select(
        "region", "customers", near.alias("within_bound"))


# --- KPIs from days ------------------------------------------------------------------------
from ledgerlens.operators import daily as _daily  # noqa: E402


def days_table(spark, sf_dir):
    """Daily sums in three batches: most rows, late rows of all days, and a batch that was run twice."""
    def write(path):
        s = sales(spark, sf_dir)
        part = _F.pmod(_F.hash("order_id"), _F.lit(10))
        _daily.add_batch(s, path, "late")
        for name, keep in (("first", part < 7), ("late", part == 7), ("again", part > 7)):
            _daily.add_batch(s.where(keep), path, name)

    return _daily.read_batches(spark, _written_once(spark, "days", sf_dir, write))


@register("kpis_from_days")
def q_kpis_from_days(spark, sf_dir):
    return _daily.compute_kpis(days_table(spark, sf_dir), 3)


@register("kpi_alerts_from_days")
def q_kpi_alerts_from_days(spark, sf_dir):
    return _kpi.alerts_of(_daily.compute_kpis(days_table(spark, sf_dir), 3), FIXTURE_TARGETS)


# --- the star join from bucketed tables ------------------------------------------------------
from ledgerlens.plans.materialize import kept_once as _kept_once  # noqa: E402
from ledgerlens.sources import bucketed as _bucketed  # noqa: E402


def bucketed_sales(spark, sf_dir):
    """The sales, joined from tables in buckets of the order key (written once per session)."""
    star = _kept_once(spark, "bucketed_star", sf_dir, lambda: _bucketed.write_star(spark, sf_dir))
    return _bucketed.sales_from_buckets(spark, star)


@register("bucketed_star_join")
def q_bucketed_star_join(spark, sf_dir):
    return bucketed_sales(spark, sf_dir)


@register("bucketed_region_performance")
def q_bucketed_region_performance(spark, sf_dir):
    return eda.region_performance(bucketed_sales(spark, sf_dir))


# --- percentiles from sketches --------------------------------------------------------------
SKETCH_ACCURACY = 0.01


@register("sketched_quartiles")
def q_sketched_quartiles(spark, sf_dir):
    """Exact quartiles of the customers' revenue, and whether those from a sketch have ranks within the bound."""
    v = rfm_values_table(spark, sf_dir)
    exact, near = _rfm.quartile_edges(v, ["monetary"]), _rfm.quartile_edges(v, ["monetary"], SKETCH_ACCURACY)
    edges = _F.array(*[_F.struct(_F.lit(p).alias("quartile"), _F.col(f"x.q{i}").alias("edge"), _F.col(f"a.q{i}").alias("near"))
                       for i, p in enumerate(_rfm.QUARTILES)])
    held = v.select("monetary", exact.alias("x"), near.alias("a")).select("monetary", _F.explode(edges).alias("e")).select(
        "monetary", "e.*")
    n = _F.count(_F.lit(1))
    ranks = held.groupBy("quartile", "edge").agg((_F.count_if(_F.col("monetary") < _F.col("near")) / n).alias("below"),
                                                 (_F.count_if(_F.col("monetary") <= _F.col("near")) / n).alias("up_to"))
    return ranks.select("quartile", "edge", ((_F.col("below") <= _F.col("quartile") + SKETCH_ACCURACY)
                                             & (_F.col("up_to") >= _F.col("quartile") - SKETCH_ACCURACY)).alias("within_bound"))
