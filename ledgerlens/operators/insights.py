"""Business insights as a small table, and their text rendering.

``insights`` returns up to seven rows ``(no, name, subject, subject2, value,
value2)`` computed from the aggregate reports; ``insight_text`` renders the
recommendation sentences. Every input is an aggregate of at most a few
hundred rows, so the union of one-row frames is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import RATIO, discount_tier_order, exact, money_sum, safe_div
from ledgerlens.sources.files import checkpoint_table
from ledgerlens.operators.stats import top_n


def _row(df: DataFrame, no: int, name: str, subject: Column, subject2: Column, value: Column,
         value2: Column) -> DataFrame:
    return df.select(F.lit(no).alias("no"), F.lit(name).alias("name"),
                     subject.cast("string").alias("subject"), subject2.cast("string").alias("subject2"),
                     value.cast("double").alias("value"), value2.cast("double").alias("value2"))


def insights(df: DataFrame) -> DataFrame:
    """Up to seven insight rows computed from the sales table.

    All component aggregates (by month of year, region, category, product,
    discount tier, customer, year, and the grand total) come from one
    grouping-sets aggregation: one scan and one shuffle of the fact table
    instead of seven. Sums are exact decimals, as in the single reports.
    The grouped table is written once under the checkpoint folder.
    """
    keys = ["year", "month", "month_name", "region", "category", "product", "customer_id", "tier_order"]
    sets = [["year", "month", "month_name"], ["region"], ["category"], ["product"], ["customer_id"],
            ["tier_order"], ["year"], []]
    src = df.select(*[c for c in keys if c != "tier_order"], "revenue", "order_id", "profit_margin",
                    discount_tier_order("discount").alias("tier_order"))
    # written once (its size is months + regions + categories + products + customers
    # + tiers + years): each branch below filters on the grouping id, and a filter
    # on grouping columns would otherwise be pushed below the aggregation, giving
    # every branch its own scan of the fact table
    g = checkpoint_table(
        src.groupingSets(sets, *keys)
        .agg(F.sum(exact("revenue")).alias("rev"), F.count("order_id").alias("orders"),
             F.sum(exact("profit_margin", RATIO)).alias("pm"), F.count("profit_margin").alias("pm_n"),
             F.grouping_id().alias("gid")), "insight_parts")
    full = (1 << len(keys)) - 1

    def of(group: list[str]) -> DataFrame:
        gid = full
        for k in group:
            gid -= 1 << (len(keys) - 1 - keys.index(k))
        cond = F.col("gid") == gid
        for k in group:
            cond = cond & F.col(k).isNotNull()
        return g.where(cond)

    revenue = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    margin = F.try_divide(F.col("pm").cast("double"), F.col("pm_n").cast("double"))
    monthly = (of(["year", "month", "month_name"]).groupBy("month", "month_name")
               .agg((F.sum("rev").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_revenue")))
    total = of([]).select(revenue.alias("_t")).select("_t").scalar()
    top10 = top_n(of(["customer_id"]).select("customer_id", revenue.alias("total_revenue")),
                  [F.col("total_revenue").desc(), F.col("customer_id")], 10)
    concentration = top10.agg(money_sum("total_revenue").alias("top_revenue")).select(
        "top_revenue", safe_div(F.col("top_revenue"), total).alias("top_share"))
    return insights_from(
        monthly_avg=monthly,
        regions=of(["region"]).select("region", revenue.alias("revenue")),
        categories=of(["category"]).select("category", revenue.alias("revenue"), margin.alias("avg_margin")),
        products=of(["product"]).select("product", revenue.alias("revenue"), F.col("orders")),
        discounts=of(["tier_order"]).select("tier_order", margin.alias("avg_margin")),
        concentration=concentration,
        years=of(["year"]).select("year", revenue.alias("total_revenue")))


def insights_from(monthly_avg: DataFrame, regions: DataFrame, categories: DataFrame, products: DataFrame,
                  discounts: DataFrame, concentration: DataFrame, years: DataFrame) -> DataFrame:
    """The insight rows from the component reports (each a small table):
    ``monthly_avg_revenue``, revenue by region, ``category_performance``,
    ``top_products``, ``discount_impact``, ``customer_concentration``,
    ``yoy_growth``. Lets a batch run derive insights from reports it already
    wrote, without another pass over the fact table."""
    none = F.lit(None)
    # 1 peak month: highest mean revenue (ties -> earlier month)
    peak = top_n(monthly_avg, [F.col("avg_revenue").desc(), F.col("month")], 1)
    i1 = _row(peak, 1, "peak_month", F.col("month_name"), none, F.col("avg_revenue"), none)
    # 2 first and last region by revenue
    reg = regions.select("region", "revenue")
    low = top_n(reg, [F.col("revenue").asc(), F.col("region").desc()], 1) \
        .select(F.struct("region", "revenue")).scalar()
    top = top_n(reg, [F.col("revenue").desc(), F.col("region")], 1)
    i2 = _row(top.select("*", low.alias("low")), 2, "region_performance", F.col("region"),
              F.col("low.region"), F.col("revenue"), F.col("low.revenue"))
    # 3 category with the highest mean margin
    best = top_n(categories, [F.col("avg_margin").desc_nulls_last(), F.col("revenue").desc(), F.col("category")], 1)
    i3 = _row(best, 3, "best_margin_category", F.col("category"), none, F.col("avg_margin"), none)
    # 4 top product
    tp = top_n(products, [F.col("revenue").desc(), F.col("product")], 1)
    i4 = _row(tp, 4, "top_product", F.col("product"), none, F.col("revenue"), F.col("orders"))
    # 5 margin gap between undiscounted and 21-30% orders, only if both tiers exist
    d = discounts.agg(
        F.max(F.when(F.col("tier_order") == 1, F.col("avg_margin"))).alias("m0"),
        F.max(F.when(F.col("tier_order") == 4, F.col("avg_margin"))).alias("m4"),
        F.count_if(F.col("tier_order") == 1).alias("c0"), F.count_if(F.col("tier_order") == 4).alias("c4"))
    i5 = _row(d.where((F.col("c0") > 0) & (F.col("c4") > 0)), 5, "discount_impact",
              F.lit("No Discount"), F.lit("21–30%"), F.col("m0") - F.col("m4"), none)
    # 6 top-10 customer share
    i6 = _row(concentration, 6, "customer_concentration", none, none, F.col("top_share"), F.col("top_revenue"))
    # 7 growth of the last year over the one before, only with >= 2 years
    yy = top_n(years, [F.col("year").desc()], 2).agg(
        F.count(F.lit(1)).alias("c"), F.min("year").alias("y0"), F.max("year").alias("y1"),
        F.max_by("total_revenue", "year").alias("r1"), F.min_by("total_revenue", "year").alias("r0"))
    i7 = _row(yy.where(F.col("c") >= 2), 7, "yoy_growth", F.col("y0"), F.col("y1"),
              safe_div(F.col("r1") - F.col("r0"), F.col("r0")), none)
    out = i1
    for x in (i2, i3, i4, i5, i6, i7):
        out = out.unionByName(x)
    return out.orderBy("no")


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit("n/a"))


def _money(c: Column) -> Column:
    return _shown(F.concat(F.lit("$"), F.format_number(c, 0)))


def _pct(c: Column) -> Column:
    return _shown(F.concat(F.format_number(c * 100, 1), F.lit("%")))


def insight_text(ins: DataFrame) -> DataFrame:
    """(no, text): one sentence with a suggestion for each insight row; missing values show as n/a."""
    s, s2, v, v2 = _shown(F.col("subject")), _shown(F.col("subject2")), F.col("value"), F.col("value2")
    n = F.col("no")

    def line(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    text = (
        F.when(n == 1, line("1. Peak month: ", s, " earns the most on average. Plan stock, campaigns and staff for it."))
        .when(n == 2, line("2. Regions: ", s, " comes first with ", _money(v), ", ", s2, " last with ", _money(v2),
                           ". Look into delivery and demand in the last one."))
        .when(n == 3, line("3. Margin: ", s, " has the best mean margin, ", _pct(v), ". Put it first in cross-selling."))
        .when(n == 4, line("4. Product: ", s, " brings in ", _money(v), " with ", _shown(F.format_number(v2, 0)),
                           " orders. Keep it in stock."))
        .when(n == 5, line("5. Discounts: margins of the highest tier are ", _pct(v),
                           " below those without discount. Keep discounts low outside clearances."))
        .when(n == 6, line("6. Customers: the top 10 make ", _pct(v), " of revenue, ", _money(v2),
                           ". Look after these accounts."))
        .when(n == 7, line("7. Growth: revenue changed by ", _pct(v), " from ", s, " to ", s2, ". ",
                           F.when(v > 0, "Invest in new customers.").otherwise("Check prices and lost customers."))))
    return ins.select("no", text.alias("text")).orderBy("no")
