"""Monthly revenue series, multiplicative decomposition, linear-trend forecast.

The series has one row per month (tens to hundreds of rows) once aggregated,
so its windows carry no partition key; all fact-level work is one grouped
aggregation by month.

Determinism: the centred trend is a mean of exact cents; the seasonal index
and the residual sigma, which are ratios, are rounded to 12 decimals, the fitted
slope and intercept to 10 significant digits, so amounts kept in cents and in
billions are fitted alike, and every later value is bit-identical across engines
and partitionings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import half_up, month_start, safe_div, significant
from ledgerlens.operators.eda import sums_by
from ledgerlens.operators.stats import centered_moving_average
from ledgerlens.sources.files import checkpoint_table


def monthly_series(df: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(ds, y): revenue per calendar month, gap-free from first to last month (gaps -> 0).

    Every month present fills the gap up to the next one, in one pass over the months: the facts are
    aggregated once; ``parts`` (see ``eda.partial_sums``) saves that too."""
    following = F.add_months(F.lead("ds").over(Window.orderBy("ds")), -1)
    return (sums_by(df, parts, "year_month")
            .select(month_start("year_month").alias("ds"), F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("y"))
            .withColumn("until", F.coalesce(following, "ds"))
            .select("y", F.posexplode(F.sequence("ds", "until", F.expr("INTERVAL 1 MONTH"))).alias("gap", "ds"))
            .select("ds", F.when(F.col("gap") == 0, F.col("y")).otherwise(F.lit(0.0)).alias("y")).orderBy("ds"))


def seasonal_index(dec: DataFrame) -> DataFrame:
    """(month, seasonal_index): mean detrended value per calendar month,
    normalised so the months average 1.0; rounded to 12 decimals."""
    raw = dec.groupBy("month").agg(F.avg("detrended").alias("_s"))
    return raw.select("month", half_up(safe_div(F.col("_s"), F.avg("_s").over(Window.partitionBy())), 12)
                      .alias("seasonal_index"))


def decompose(series: DataFrame, period: int = 12) -> DataFrame:
    """ds, y, trend (centred mean, >= period/2 points), detrended = y/trend,
    month, seasonal, residual = detrended/seasonal."""
    d = (centered_moving_average(series, "y", "ds", period, period // 2, "trend")
         .withColumn("detrended", safe_div("y", "trend"))
         .withColumn("month", F.month("ds")))
    idx = seasonal_index(d)
    return (d.join(idx, "month", "left")
            .select("ds", "y", "trend", "detrended", "month",
                    F.col("seasonal_index").alias("seasonal"),
                    safe_div("detrended", "seasonal_index").alias("residual"))
            .orderBy("ds"))


def fit_trend(dec: DataFrame) -> DataFrame:
    """Least-squares line through the non-null trend values at x = 0..n-1:
    one row (slope, intercept, n_valid)."""
    v = dec.where(F.col("trend").isNotNull()).select(
        "trend", (F.row_number().over(Window.orderBy("ds")) - 1).cast("double").alias("x"))
    fit = v.agg(F.regr_slope("trend", "x").alias("slope"), F.regr_intercept("trend", "x").alias("intercept"),
                F.count(F.lit(1)).alias("n_valid"))
    return fit.select(significant("slope").alias("slope"), significant("intercept").alias("intercept"), "n_valid")


def _clip0(c):
    """max(c, 0) keeping null (``greatest`` alone would turn null into 0)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def forecast(df: DataFrame, periods: int = 6, parts: DataFrame | None = None) -> DataFrame:
    """History and ``periods`` future months: ds, actual, trend, seasonal,
    forecast, ci_lower, ci_upper. Future trend is the fitted line clipped at 0;
    the band is forecast * (1 -/+ sigma of residuals), lower clipped at 0."""
    # the monthly series (one row per month) feeds five branches below; written
    # once, so the fact table is aggregated once instead of once per branch
    dec = decompose(checkpoint_table(monthly_series(df, parts), "monthly_series"))
    idx = seasonal_index(dec).withColumn("_present", F.lit(True))
    fit = fit_trend(dec)
    st = dec.agg(F.max("ds").alias("last_ds"),
                 half_up(F.stddev_samp("residual"), 12).alias("sd"))
    params = fit.select(F.struct("slope", "intercept", "n_valid").alias("f")).scalar()
    hist = dec.select(F.col("ds"), F.col("y").alias("actual"), "trend", "seasonal",
                      (F.col("trend") * F.col("seasonal")).alias("forecast"),
                      F.lit(None).cast("double").alias("ci_lower"),
                      F.lit(None).cast("double").alias("ci_upper"))
    fut = (st.select("sd", "last_ds", params.alias("f"),
                     F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))
           .select("sd", "f", "h", F.add_months("last_ds", F.col("h")).alias("ds"))
           .withColumn("month", F.month("ds")))
    fut = (fut.join(idx, "month", "left")
           .withColumn("trend", _clip0(F.col("f.slope") * (F.col("f.n_valid") + F.col("h") - 1).cast("double")
                                       + F.col("f.intercept")))
           .withColumn("seasonal", F.when(F.col("_present").isNull(), F.lit(1.0))
                       .otherwise(F.col("seasonal_index")))
           .withColumn("forecast", F.col("trend") * F.col("seasonal")))
    fut = fut.select("ds", F.lit(None).cast("double").alias("actual"), "trend", "seasonal", "forecast",
                     _clip0(F.col("forecast") - F.col("forecast") * F.col("sd")).alias("ci_lower"),
                     (F.col("forecast") + F.col("forecast") * F.col("sd")).alias("ci_upper"))
    return hist.unionByName(fut).orderBy("ds")


def forecast_summary(fc: DataFrame) -> DataFrame:
    """Future rows only, labelled 'Mon YYYY'."""
    return (fc.where(F.col("actual").isNull())
            .select("ds", F.date_format("ds", "MMM yyyy").alias("month_label"),
                    "forecast", "ci_lower", "ci_upper")
            .orderBy("ds"))
