"""KPI monitoring: current KPIs over a trailing window, GREEN/YELLOW/RED
classification against targets, alert counts, and a monthly KPI history.

All fact-level work is one aggregation (current KPIs) or one aggregation by
month (history); the trailing 3-month window then runs over the month rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.constants import KPI_CONFIG, KPI_KEYS
from ledgerlens.operators.eda import sums_by
from ledgerlens.functions.exprs import RATIO, exact, exact_avg, money_avg, money_sum, safe_div

DISCOUNT = "decimal(38,8)"


def kpi_config(targets: dict[str, float] | None = None) -> list[tuple]:
    """The KPI table with optional target overrides: (order, key, label, unit,
    target, warn, crit, higher_is_better)."""
    targets = targets or {}
    return [(i + 1, k, label, unit, float(targets.get(k, tgt)), warn, crit, hib)
            for i, (k, label, unit, tgt, warn, crit, hib) in enumerate(KPI_CONFIG)]


def compute_kpis(df: DataFrame, window_months: int = 3) -> DataFrame:
    """One row: the five KPIs over rows with date >= max(date) - window_months
    (calendar months, inclusive). Totals are divided by the number of distinct
    months present in that range (at least 1).

    The window's start is a scalar subquery over the ``date`` column alone, evaluated
    when the query runs; with a ``year`` column (the written tables are partitioned
    by it) folders of older years are not read at all.
    """
    dated = df.where(F.col("year").isNotNull()) if "year" in df.columns else df       # rows without a date have no year
    start = dated.agg(F.add_months(F.max("date"), -window_months).alias("start"))
    recent = dated.where(F.col("date") >= start.scalar())
    if "year" in df.columns:
        recent = recent.where(F.col("year") >= start.select(F.year("start")).scalar())
    n = F.greatest(F.count_distinct("year_month"), F.lit(1)).cast("double")
    return recent.agg(
        (money_sum("revenue") / n).alias("monthly_revenue"),
        money_avg("revenue").alias("avg_order_value"),
        exact_avg("profit_margin", RATIO).alias("profit_margin"),
        (F.count(F.lit(1)).cast("double") / n).alias("order_count"),
        exact_avg("discount", DISCOUNT).alias("discount_rate"),
    )


def classify(value: Column, target: Column, warn: Column, crit: Column, higher: Column) -> Column:
    """GREEN / YELLOW / RED for a value against its target (null value -> RED)."""
    ratio = F.when(target != 0, value / target).otherwise(F.lit(1.0))
    up = F.when(ratio >= warn, "GREEN").when(ratio >= crit, "YELLOW").otherwise("RED")
    down = F.when(ratio <= warn, "GREEN").when(ratio <= crit, "YELLOW").otherwise("RED")
    return F.when(value.isNull(), F.lit("RED")).when(higher, up).otherwise(down)


def _config_rows(targets) -> Column:
    return F.array(*[F.struct(F.lit(o).alias("kpi_order"), F.lit(k).alias("key"), F.lit(lab).alias("label"),
                              F.lit(u).alias("unit"), F.lit(t).alias("target"), F.lit(w).alias("warn_pct"),
                              F.lit(c).alias("crit_pct"), F.lit(h).alias("higher_is_better"),
                              F.col(k).alias("value"))
                     for o, k, lab, u, t, w, c, h in kpi_config(targets)])


def kpi_alerts(df: DataFrame, window_months: int = 3, targets: dict[str, float] | None = None) -> DataFrame:
    """One alert row per KPI: value, target, ratio, status, pct_vs_target."""
    return alerts_of(compute_kpis(df, window_months), targets)


def alerts_of(kpis: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``kpi_alerts`` from the one row of ``compute_kpis``."""
    k = kpis.select(F.explode(_config_rows(targets)).alias("a")).select("a.*")
    v, t = F.col("value"), F.col("target")
    return k.select(
        "kpi_order", "key", "label", "value", "target",
        classify(v, t, F.col("warn_pct"), F.col("crit_pct"), F.col("higher_is_better")).alias("status"),
        F.when(t != 0, (v - t) / t * F.lit(100.0)).alias("pct_vs_target"),
        F.when(t != 0, v / t).otherwise(F.lit(1.0)).alias("ratio"),
        "higher_is_better", "unit")


def kpi_alert_counts(alerts: DataFrame) -> DataFrame:
    """RED / YELLOW / GREEN counts and the RED labels in KPI order."""
    reds = F.filter(F.array_sort(F.collect_list(F.struct("kpi_order", "label", "status"))),
                    lambda s: s["status"] == "RED")
    return alerts.agg(F.count_if(F.col("status") == "RED").alias("red"),
                      F.count_if(F.col("status") == "YELLOW").alias("yellow"),
                      F.count_if(F.col("status") == "GREEN").alias("green"),
                      F.array_join(F.transform(reds, lambda s: s["label"]), ", ").alias("red_labels"))


def kpi_display(alerts: DataFrame) -> DataFrame:
    """Presentation strings: '$1,234.56', '12.3%', '1,234.5' by unit; missing values show as n/a."""
    def fmt(c: Column) -> Column:
        return F.coalesce(F.when(F.col("unit") == "$", F.concat(F.lit("$"), F.format_number(c, 2)))
                .when(F.col("unit") == "%", F.concat(F.format_number(c * 100, 1), F.lit("%")))
                .otherwise(F.format_number(c, 1)), F.lit("n/a"))
    return alerts.select("kpi_order", "key", "label", "status", fmt(F.col("value")).alias("display_value"),
                         fmt(F.col("target")).alias("display_target"),
                         F.when(F.col("pct_vs_target").isNull(), "n/a").otherwise(
                             F.format_string("%+.1f%%", F.col("pct_vs_target"))).alias("display_pct"))


def monthly_kpi_parts(df: DataFrame) -> DataFrame:
    """Per month: exact sums and counts the trailing KPIs are built from."""
    return (df.where(F.col("year_month").isNotNull()).groupBy("year_month")
            .agg(F.sum(exact("revenue")).alias("rev"),
                 F.count("revenue").alias("rev_n"), F.count(F.lit(1)).alias("rows"),
                 F.sum(exact("profit_margin", RATIO)).alias("pm"), F.count("profit_margin").alias("pm_n"),
                 F.sum(exact("discount", DISCOUNT)).alias("disc"), F.count("discount").alias("disc_n")))


def rolling_kpi_window(parts: DataFrame, months: int = 3) -> DataFrame:
    """Trailing sums over the last ``months`` months present (rows, not calendar)."""
    w = Window.orderBy("year_month").rowsBetween(-(months - 1), 0)
    return parts.select(
        "year_month", F.count(F.lit(1)).over(w).alias("months_in_window"),
        F.sum("rev").over(w).cast("double").alias("revenue_w"), F.sum("rev_n").over(w).alias("rev_n_w"),
        F.sum("rows").over(w).alias("rows_w"),
        F.sum("pm").over(w).cast("double").alias("pm_w"), F.sum("pm_n").over(w).alias("pm_n_w"),
        F.sum("disc").over(w).cast("double").alias("disc_w"), F.sum("disc_n").over(w).alias("disc_n_w"))


def kpi_history(df: DataFrame, targets: dict[str, float] | None = None, months: int = 3,
                parts: DataFrame | None = None) -> DataFrame:
    """Per month present: the five KPIs over that month and the previous
    ``months - 1`` months present, row-weighted, plus one status column per KPI."""
    monthly = monthly_kpi_parts(df) if parts is None else sums_by(df, parts, "year_month")
    return kpi_history_from_parts(monthly, targets, months)


def kpi_history_from_parts(parts: DataFrame, targets: dict[str, float] | None = None,
                           months: int = 3) -> DataFrame:
    """``kpi_history`` from a table of monthly parts (see ``monthly_kpi_parts``)."""
    r = rolling_kpi_window(parts, months)
    n = F.col("months_in_window").cast("double")
    h = r.select(
        "year_month",
        (F.col("revenue_w") / n).alias("monthly_revenue"),
        safe_div(F.col("revenue_w"), F.col("rev_n_w").cast("double")).alias("avg_order_value"),
        safe_div(F.col("pm_w"), F.col("pm_n_w").cast("double")).alias("profit_margin"),
        (F.col("rows_w").cast("double") / n).alias("order_count"),
        safe_div(F.col("disc_w"), F.col("disc_n_w").cast("double")).alias("discount_rate"))
    for o, k, _, _, t, w, c, hib in kpi_config(targets):
        h = h.withColumn(f"{k}_status", classify(F.col(k), F.lit(t), F.lit(w), F.lit(c), F.lit(hib)))
    return h.orderBy("year_month")


__all__ = ["KPI_KEYS", "compute_kpis", "classify", "kpi_alerts", "kpi_alert_counts", "kpi_display",
           "monthly_kpi_parts", "rolling_kpi_window", "kpi_history", "kpi_history_from_parts", "kpi_config"]
