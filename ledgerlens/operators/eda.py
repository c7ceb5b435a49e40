"""Aggregate reports over the cleaned sales table.

Conventions shared by every report (pandas semantics made explicit):
* null group keys are dropped before grouping;
* "orders" is a row count (non-null ``order_id``), never distinct orders;
* margins are means of row margins, not ratios of sums;
* money sums are exact (see ``functions.exprs``); ties in every top-n are
  broken by the group key so results are deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.constants import HISTOGRAM_BINS, HISTOGRAM_CLIP_QUANTILE
from ledgerlens.functions.exprs import (
    RATIO, discount_tier, discount_tier_order, exact, exact_avg, half_up, money_avg, money_sum,
    month_start, safe_div,
)
from ledgerlens.operators.stats import (
    bin_edges, equal_width_bins, percentiles_of, share_of_total, sketched_quantile, top_n, value_ranks, value_sketches,
)
from ledgerlens.sources.files import checkpoint_table


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


MONTH_KEYS = ["year", "month", "month_name", "year_month"]


def partial_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact sums and counts per group (null keys included), from which every report by
    these keys, or by fewer of them, can be put together without another scan."""
    return df.groupBy(*keys).agg(
        F.sum(exact("revenue")).alias("rev"), F.count("revenue").alias("rev_n"),
        F.sum(exact("profit")).alias("prof"), F.count("order_id").alias("orders"), F.count(F.lit(1)).alias("rows"),
        F.sum(exact("profit_margin", RATIO)).alias("pm"), F.count("profit_margin").alias("pm_n"),
        F.sum(exact("discount", RATIO)).alias("disc"), F.count("discount").alias("disc_n"),
        F.max("date").alias("last_date"))


def sums_by(df: DataFrame, parts: DataFrame | None, *keys: str) -> DataFrame:
    """``partial_sums`` by ``keys`` without null keys: of the rows of ``df``, or added up from ``parts``."""
    if parts is None:
        return partial_sums(_keyed(df, *keys), list(keys))
    return _keyed(parts, *keys).groupBy(*keys).agg(*added_up())


def added_up() -> list[Column]:
    """Aggregates that merge rows of ``partial_sums``."""
    return [F.sum(c).alias(c) for c in ("rev", "rev_n", "prof", "orders", "rows", "pm", "pm_n", "disc", "disc_n")] + [
        F.max("last_date").alias("last_date")]


def amount(c: str) -> Column:
    """A sum of ``partial_sums`` as double; no values sum to 0.0."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def mean_of(total: str, n: str) -> Column:
    """The mean from a sum and a count of ``partial_sums``; null without values."""
    return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))


def summary_stats(df: DataFrame) -> DataFrame:
    """One row: totals, counts, means and the top category and region (largest revenue,
    ties -> smallest name). One grouping-sets pass over the facts, written once (categories +
    regions + 1 rows), and one over the customers' ids, the only column shuffled for their number."""
    keys = ["category", "region"]
    g = checkpoint_table(df.groupingSets([["category"], ["region"], []], *keys).agg(
        F.sum(exact("revenue")).alias("rev"), F.count(exact("revenue")).alias("rev_n"), F.sum(exact("profit")).alias("prof"),
        F.count(F.lit(1)).alias("rows"), F.sum(exact("profit_margin", RATIO)).alias("pm"),
        F.count(exact("profit_margin", RATIO)).alias("pm_n"), F.grouping_id().alias("gid")), "summary_parts")

    def top(key: str, gid: int):
        return top_n(g.where((F.col("gid") == gid) & F.col(key).isNotNull()),
                     [amount("rev").desc(), F.col(key)], 1).select(key).scalar()

    customers = df.agg(F.count_distinct("customer_id")).scalar()
    return g.where(F.col("gid") == 0b11).select(
        amount("rev").alias("total_revenue"), amount("prof").alias("total_profit"),
        F.col("rows").alias("total_orders"), customers.alias("unique_customers"),
        mean_of("rev", "rev_n").alias("avg_order_value"), mean_of("pm", "pm_n").alias("avg_profit_margin"),
        top("category", 0b01).alias("top_category"), top("region", 0b10).alias("top_region"))


def overview_cards(df: DataFrame) -> DataFrame:
    """The six dashboard headline values (usually on ``filter_sales`` output)."""
    return df.agg(
        money_sum("revenue").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        exact_avg("profit_margin", RATIO).alias("avg_margin"),
        F.count(F.lit(1)).alias("orders"),
        money_avg("revenue").alias("avg_order_value"),
        F.count_distinct("customer_id").alias("customers"),
    )


def monthly_sales_trend(df: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``parts``, here and below: ``partial_sums`` already at hand, used instead of the facts."""
    return (sums_by(df, parts, "year_month")
            .select("year_month", amount("rev").alias("revenue"), amount("prof").alias("profit"), "orders",
                    month_start("year_month").alias("year_month_dt"))
            .orderBy("year_month_dt"))


def yoy_growth(df: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Revenue per year with growth over the previous year present."""
    y = sums_by(df, parts, "year").select("year", amount("rev").alias("total_revenue"))
    prev = F.lag("total_revenue").over(Window.orderBy("year"))
    return y.withColumn("growth", safe_div(F.col("total_revenue") - prev, prev)).orderBy("year")


def top_products(df: DataFrame, n: int = 10, parts: DataFrame | None = None) -> DataFrame:
    g = sums_by(df, parts, "product").select(
        "product", amount("rev").alias("revenue"), amount("prof").alias("profit"), "orders",
        mean_of("pm", "pm_n").alias("avg_margin"))
    return top_n(g, [F.col("revenue").desc(), F.col("product")], n)


def bottom_products(df: DataFrame, n: int = 5, parts: DataFrame | None = None) -> DataFrame:
    g = sums_by(df, parts, "product").select("product", amount("rev").alias("revenue"), amount("prof").alias("profit"))
    return top_n(g, [F.col("profit").asc(), F.col("product")], n)


def category_performance(df: DataFrame) -> DataFrame:
    g = (_keyed(df, "category").groupBy("category")
         .agg(money_sum("revenue").alias("revenue"), money_sum("profit").alias("profit"),
              F.count("order_id").alias("orders"),
              exact_avg("profit_margin", RATIO).alias("avg_margin")))
    return share_of_total(g, "revenue", "revenue_share", 4).orderBy(F.col("revenue").desc(), "category")


def region_performance(df: DataFrame) -> DataFrame:
    return (_keyed(df, "region").groupBy("region")
            .agg(money_sum("revenue").alias("revenue"), money_sum("profit").alias("profit"),
                 F.count("order_id").alias("orders"),
                 F.count_distinct("customer_id").alias("customers"),
                 money_avg("revenue").alias("avg_order_value"))
            .orderBy(F.col("revenue").desc(), "region"))


def city_performance(df: DataFrame, n: int = 10) -> DataFrame:
    g = _keyed(df, "region", "city").groupBy("region", "city").agg(money_sum("revenue").alias("revenue"))
    return top_n(g, [F.col("revenue").desc(), F.col("region"), F.col("city")], n)


def top_customers(df: DataFrame, n: int = 10, parts: DataFrame | None = None) -> DataFrame:
    g = sums_by(df, parts, "customer_id").select(
        "customer_id", amount("rev").alias("total_revenue"), F.col("orders").alias("total_orders"),
        mean_of("rev", "rev_n").alias("avg_order_value"), amount("prof").alias("total_profit"))
    return top_n(g, [F.col("total_revenue").desc(), F.col("customer_id")], n)


def segment_analysis(df: DataFrame) -> DataFrame:
    g = (_keyed(df, "segment").groupBy("segment")
         .agg(money_sum("revenue").alias("revenue"), F.count("order_id").alias("orders"),
              F.count_distinct("customer_id").alias("customers")))
    return (g.withColumn("revenue_per_customer", half_up(safe_div("revenue", "customers"), 2))
            .orderBy(F.col("revenue").desc(), "segment"))


def monthly_avg_revenue(df: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Revenue per (year, month), then the mean over the years present; calendar order."""
    return (sums_by(df, parts, "year", "month", "month_name").groupBy("month", "month_name")
            .agg((F.sum("rev").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_revenue"))
            .orderBy("month"))


#: A table with a column per region is for people to look at.
MAX_REGIONS = 1000


def heatmap_data(df: DataFrame, regions: list[str] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Revenue by month (rows, calendar order, only months present) x region
    (columns), missing cells 0. The facts are aggregated once to month x region;
    where ``regions`` is not given, the column names come from that small table.
    More than ``MAX_REGIONS`` columns raise."""
    keys = ["month", "month_name", "region"]
    if parts is None:
        cells = checkpoint_table(_keyed(df, *keys).groupBy(*keys).agg(money_sum("revenue").alias("revenue")), "heatmap_cells")
    else:
        cells = sums_by(df, parts, *keys).select(*keys, amount("rev").alias("revenue"))
    if regions is None:
        regions = sorted(r[0] for r in cells.select("region").distinct().limit(MAX_REGIONS + 1).collect())
        if len(regions) > MAX_REGIONS:
            raise ValueError(f"more than {MAX_REGIONS} regions: name those to show")
    aggs = [F.coalesce(F.max(F.when(F.col("region") == r, F.col("revenue"))), F.lit(0.0)).alias(r) for r in regions]
    return cells.groupBy("month", "month_name").agg(*aggs).orderBy("month")


def discount_impact(df: DataFrame) -> DataFrame:
    """Per discount tier: mean margin, mean revenue, orders; tier order; empty tiers absent."""
    return (df.withColumn("discount_tier", discount_tier("discount"))
            .withColumn("tier_order", discount_tier_order("discount"))
            .where(F.col("discount_tier").isNotNull())
            .groupBy("tier_order", "discount_tier")
            .agg(exact_avg("profit_margin", RATIO).alias("avg_margin"),
                 money_avg("revenue").alias("avg_revenue"),
                 F.count("order_id").alias("orders"))
            .orderBy("tier_order"))


def order_value_distribution(df: DataFrame) -> DataFrame:
    return df.select("revenue")


def order_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS,
                    clip: float = HISTOGRAM_CLIP_QUANTILE) -> DataFrame:
    """Histogram of revenue clipped at its ``clip`` quantile: ``bins`` equal
    bins over [min, max] of the kept values (all bins, zeros included), with the
    mean and median of the kept values on every row.

    The facts are read once, into ranked value counts (``value_ranks``): clip
    value, range, mean, median and bins all come from that table, by the same
    plan at every size. Kept values keep their ranks, so the median needs no
    second ranking.
    """
    ranks = checkpoint_table(value_ranks(df, ["revenue"]), "revenue_ranks")
    cap = percentiles_of(ranks, [(0, clip)]).scalar()
    kept = ranks.where(F.col("value") <= cap)
    amount = F.sum(exact("value") * F.col("c")).cast("double")
    st = kept.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n"),
                           (amount / F.sum("c").cast("double")).alias("mean"))).scalar()
    median = percentiles_of(kept.withColumn("n", st.getField("n")), [(0, 0.5)]).scalar()
    lo, hi = F.col("st.lo"), F.col("st.hi")
    counts = (kept.select("value", "c", st.alias("st"))
              .groupBy(equal_width_bins(F.col("value"), lo, hi, bins).alias("bin")).agg(F.sum("c").alias("orders")))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), st.alias("st"),
                                               cap.alias("cap"), median.alias("median"))
    lower, upper = bin_edges(lo, hi, F.col("bin"), bins)
    return (spine.join(counts, "bin", "left")
            .where(lo.isNotNull())
            .select("bin", lower.alias("bin_lower"), upper.alias("bin_upper"),
                    F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
                    F.col("cap").alias("clip_value"), F.col("st.mean").alias("mean_value"),
                    F.col("median").alias("median_value"))
            .orderBy("bin"))


def order_histogram_sketch(df: DataFrame, accuracy: float, bins: int = HISTOGRAM_BINS,
                           clip: float = HISTOGRAM_CLIP_QUANTILE) -> DataFrame:
    """``order_histogram`` from one quantile sketch, in one scan and without writing anything. The kept values are
    represented by evenly spaced quantiles, two for each ``accuracy``: the clip value and the median have ranks off
    by ``accuracy`` at most, a bin's orders are off by three times that share of all orders, and the mean is that of
    the quantiles."""
    steps = math.ceil(2 / accuracy)
    ps = [(i + 0.5) / steps * clip for i in range(steps)]
    s = value_sketches(df, ["revenue"], accuracy).select(F.col("sketch_revenue").alias("s"))
    one = s.where(F.kll_sketch_get_n_double("s") > 0).select(
        (F.kll_sketch_get_n_double("s") * F.lit(clip / steps)).alias("weight"), sketched_quantile(F.col("s"), 0.0).alias("lo"),
        sketched_quantile(F.col("s"), clip).alias("hi"), sketched_quantile(F.col("s"), clip / 2).alias("median"),
        F.kll_sketch_get_quantile_double("s", F.lit(ps)).alias("values"))
    one = one.withColumn("mean", F.aggregate("values", F.lit(0.0), lambda a, x: a + x / steps))
    bin_of = F.transform("values", lambda x: equal_width_bins(x, F.col("lo"), F.col("hi"), bins))
    spread = one.select("weight", "lo", "hi", "median", "mean", bin_of.alias("held"),
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lower, upper = bin_edges(F.col("lo"), F.col("hi"), F.col("bin"), bins)
    orders = F.size(F.filter("held", lambda b: b == F.col("bin"))) * F.col("weight")
    return spread.select("bin", lower.alias("bin_lower"), upper.alias("bin_upper"),
                         F.round(orders).cast("bigint").alias("orders"), F.col("hi").alias("clip_value"),
                         F.col("mean").alias("mean_value"), F.col("median").alias("median_value")).orderBy("bin")


def customer_concentration(df: DataFrame, n: int = 10, parts: DataFrame | None = None) -> DataFrame:
    """Revenue of the top ``n`` customers and its share of all revenue, from one
    aggregate per customer (rows without one included), written once."""
    each = checkpoint_table(partial_sums(df, ["customer_id"]).select("customer_id", "rev"),
                            "customer_revenue") if parts is None else parts
    total = each.agg(F.sum("rev").alias("rev")).select(amount("rev")).scalar()
    top = top_n(_keyed(each, "customer_id"), [amount("rev").desc(), F.col("customer_id")], n).agg(
        F.sum("rev").alias("rev")).select(amount("rev").alias("top_revenue"))
    return top.select("top_revenue", total.alias("total_revenue"),
                      safe_div(F.col("top_revenue"), total).alias("top_share"))
