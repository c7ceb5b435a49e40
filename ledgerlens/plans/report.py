"""The batch analysis run: clean the raw export once, write it, then compute
every report from the written table.

The cleaned table is written (parquet, partitioned by year) to a path you
give, or under the shared checkpoint folder: later stages read files, so a
lost executor never re-runs the cleaning, and each report reads only the
columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import clean, cube, eda, forecast, insights, kpi, rfm
from ledgerlens.session import scratch_path
from ledgerlens.sources.files import write_clean, write_report
from ledgerlens.sources.load import load_audit, load_sales


def report_builders(sales: DataFrame, top_n: int = 10, horizon: int = 6, kpi_window: int = 3,
                    kpi_targets: dict | None = None,
                    segments: DataFrame | None = None,
                    parts: dict[str, DataFrame] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every report of the analysis as a zero-argument builder over ``sales``
    (and ``segments``, the scored customer table, computed if not given).
    ``parts`` are written tables that answer reports in place of ``sales``: ``cells`` and
    ``buyers`` (the two tables of a ``cube.SalesCube``), and ``eda.partial_sums`` by
    ``product`` and by ``customer``.

    Builders let the writer construct each plan in its own thread: building a
    large DataFrame (analysis of the plan, size checks) overlaps with the
    execution of other reports.
    """
    month, buyers, product, customer = [(parts or {}).get(k) for k in ("cells", "buyers", "product", "customer")]
    cells = cube.SalesCube(month, buyers) if month is not None and buyers is not None else None
    over = lambda report, *a: (lambda: getattr(eda, report)(sales, *a) if cells is None else getattr(cube, report)(cells, *a))
    segs = (lambda: rfm.compute_rfm(sales)) if segments is None else (lambda: segments)
    fc = lambda: forecast.forecast(sales, horizon, month)
    alerts = lambda: kpi.kpi_alerts(sales, kpi_window, kpi_targets)
    ins = lambda: insights.insights(sales)
    return {
        "summary_stats": over("summary_stats"),
        "data_quality": lambda: clean.data_quality_report(sales),
        "monthly_sales_trend": lambda: eda.monthly_sales_trend(sales, month),
        "yoy_growth": lambda: eda.yoy_growth(sales, month),
        "top_products": lambda: eda.top_products(sales, top_n, product),
        "bottom_products": lambda: eda.bottom_products(sales, 5, product),
        "category_performance": over("category_performance"),
        "region_performance": over("region_performance"),
        "city_performance": over("city_performance", top_n),
        "top_customers": lambda: eda.top_customers(sales, top_n, customer),
        "segment_analysis": over("segment_analysis"),
        "monthly_avg_revenue": lambda: eda.monthly_avg_revenue(sales, month),
        "heatmap_data": over("heatmap_data"),
        "discount_impact": over("discount_impact"),
        "order_histogram": lambda: eda.order_histogram(sales),
        "customer_concentration": lambda: eda.customer_concentration(sales, parts=customer),
        "insights": ins,
        "insight_text": lambda: insights.insight_text(ins()),
        "rfm": segs,
        "segment_summary": lambda: rfm.segment_summary(segs()),
        "rfm_grid": lambda: rfm.rfm_grid(segs()),
        "forecast": fc,
        "forecast_summary": lambda: forecast.forecast_summary(fc()),
        "kpi_alerts": alerts,
        "kpi_alert_counts": lambda: kpi.kpi_alert_counts(alerts()),
        "kpi_history": lambda: kpi.kpi_history(sales, kpi_targets, parts=month),
    }


def report_tables(sales: DataFrame, **kwargs) -> dict[str, DataFrame]:
    """Every report of the analysis as DataFrames (see ``report_builders``)."""
    return {k: f() for k, f in report_builders(sales, **kwargs).items()}


def run_analysis_csv(spark: SparkSession, path: str, out_dir: str | None = None, parallel: int = 8,
                     multi_line: bool = False, date_format: str = "yyyy-MM-dd", **report_args) -> dict[str, str]:
    """``run_analysis`` of a CSV export. Also writes what did not fit: ``bad_rows`` (lines with stray fields),
    ``loading_audit`` (rows by step, from the lines to the clean rows) and ``parse_failures`` (values per column
    that could not be read, which shows a wrong ``date_format``)."""
    out_dir = out_dir or scratch_path(spark, "analysis")
    load = load_sales(spark, path, f"{out_dir}/sales_raw", multi_line)
    paths = run_analysis(spark, load.rows, out_dir, parallel, date_format=date_format, **report_args)
    paths.update(write_report({
        "bad_rows": load.bad_rows,
        "loading_audit": lambda: clean.cleaning_audit(load.rows, date_format, load_audit(load), by="fingerprint"),
        "parse_failures": lambda: clean.parse_failures(load.rows, date_format)}, f"{out_dir}/loading", parallel=parallel))
    paths["sales_raw"] = f"{out_dir}/sales_raw"
    return paths


def run_analysis(spark: SparkSession, raw: DataFrame, out_dir: str | None = None, parallel: int = 8,
                 date_format: str = "yyyy-MM-dd", **report_args) -> dict[str, str]:
    """Clean ``raw``, write the clean table, write every report table; returns paths."""
    out_dir = out_dir or scratch_path(spark, "analysis")
    cleaned = clean.clean_sales(raw, date_format=date_format)
    clean_path = write_clean(cleaned, f"{out_dir}/sales_clean", "parquet", "year")
    sales = spark.read.parquet(clean_path)
    # partial sums that most reports share, and the scored customers: written once
    shared = {"cells": lambda: cube.cells(sales), "buyers": lambda: cube.customer_sets(sales, ["region", "segment"], "ids"),
              "product": lambda: eda.partial_sums(sales, ["product"]),
              "customer": lambda: eda.partial_sums(sales, ["customer_id"])}
    written = write_report(shared, f"{out_dir}/parts", parallel=parallel)
    parts = {k: spark.read.parquet(p) for k, p in written.items()}
    rfm_path = f"{out_dir}/rfm"
    rfm.compute_rfm(sales, parts=parts["customer"]).write.mode("overwrite").parquet(rfm_path)
    segs = spark.read.parquet(rfm_path)
    tables = report_builders(sales, segments=segs, parts=parts, **report_args)
    tables.pop("rfm")
    # tables derived from other report tables are built from the written parents
    derived = {"forecast_summary": ("forecast", forecast.forecast_summary),
               "kpi_alert_counts": ("kpi_alerts", kpi.kpi_alert_counts)}
    for name in list(derived) + ["insights", "insight_text"]:
        tables.pop(name)
    paths = write_report(tables, f"{out_dir}/reports", parallel=parallel)
    read = lambda name: spark.read.parquet(paths[name])
    second = {name: (lambda fn=fn, parent=parent: fn(read(parent))) for name, (parent, fn) in derived.items()}
    second["insights"] = lambda: insights.insights_from(
        read("monthly_avg_revenue"), read("region_performance"), read("category_performance"),
        read("top_products"), read("discount_impact"), read("customer_concentration"),
        read("yoy_growth"))
    paths.update(write_report(second, f"{out_dir}/reports", parallel=parallel))
    paths.update(write_report({"insight_text": insights.insight_text(read("insights"))},
                              f"{out_dir}/reports", parallel=1))
    paths["sales_clean"] = clean_path
    paths["rfm"] = rfm_path
    return paths
