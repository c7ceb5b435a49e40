"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Written independently of the DataFrame code: full sorts and window functions
where the Spark side uses sketches and range partitioning. Numeric rules match
``functions.exprs``: half-up rounding as ``floor(x*10^n+0.5)/10^n``, money
summed as ``decimal(18,2)``.
"""

from __future__ import annotations

# the clean, typed sales table built from the star schema
SALES = """
b AS (
  SELECT 'ORD-' || cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_partkey AS varchar) || '-' || cast(l_suppkey AS varchar) AS order_id,
         'CUST-' || cast(o_custkey AS varchar) AS customer_id,
         c_mktsegment AS segment, cast(o_orderdate AS date) AS date,
         p_name AS product, upper(substr(p_type,1,1)) || lower(substr(p_type,2)) AS category,
         r_name AS region, n_name AS city,
         cast(l_quantity AS bigint) AS quantity,
         floor(l_extendedprice/l_quantity*100+0.5)/100 AS unit_price,
         floor(l_discount*100+0.5)*3/100 AS discount,
         cast(0.1 AS double)+l_tax+p_size/cast(200 AS double) AS margin
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey JOIN part ON l_partkey=p_partkey),
c AS (SELECT *, floor(unit_price*quantity*(1-discount)*100+0.5)/100 AS revenue FROM b),
sales AS (
  SELECT order_id, customer_id, segment, date, product, category, region, city,
         quantity, unit_price, discount, revenue, floor(revenue*margin*100+0.5)/100 AS profit
  FROM c)"""

FEATURES = """
s AS (
  SELECT *, cast(year(date) AS integer) AS year, cast(month(date) AS integer) AS month,
         strftime(date, '%b') AS month_name, cast(quarter(date) AS integer) AS quarter,
         strftime(date, '%Y-%m') AS year_month,
         floor(profit / nullif(revenue, 0) * 10000 + 0.5) / 10000 AS profit_margin
  FROM sales)"""


def msum(x: str) -> str:
    return f"coalesce(cast(sum(cast({x} AS decimal(18,2))) AS double), 0.0)"


def mavg(x: str, dec: str = "decimal(18,2)") -> str:
    return f"(cast(sum(cast({x} AS {dec})) AS double) / nullif(cast(count({x}) AS double), 0))"


def ravg(x: str) -> str:
    return mavg(x, "decimal(18,4)")


def half_up(x: str, n: int) -> str:
    return f"(floor(({x}) * {10 ** n}.0 + 0.5) / {10 ** n}.0)"


def with_sales(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return "WITH " + SALES + "," + FEATURES + extra + "\n" + body


def _body(q: str) -> str:
    """The part of a registered query after the sales and feature CTEs."""
    return q.split(FEATURES, 1)[1]


def _nested(q: str) -> str:
    """That part as a query of its own, over the CTE ``s``."""
    body = _body(q)
    return "WITH " + body[1:] if body.startswith(",") else body


Q: dict[str, str] = {}

Q["region_performance"] = with_sales(f"""
SELECT region, {msum('revenue')} AS revenue, {msum('profit')} AS profit,
       count(order_id) AS orders, count(DISTINCT customer_id) AS customers,
       {mavg('revenue')} AS avg_order_value
FROM s WHERE region IS NOT NULL GROUP BY region""")


def pct(src: str, col: str, p: float) -> str:
    """Scalar subquery: linear-interpolation percentile by a full sort."""
    return f"""(SELECT CASE WHEN pos IS NULL THEN NULL
                     WHEN floor(pos) = ceil(pos) OR v0 = v1 THEN v0
                     ELSE (ceil(pos) - pos) * v0 + (pos - floor(pos)) * v1 END
   FROM (SELECT any_value(pos) AS pos,
                max(CASE WHEN i = floor(pos) THEN x END) AS v0,
                max(CASE WHEN i = ceil(pos) THEN x END) AS v1
         FROM (SELECT cast({col} AS double) AS x, row_number() OVER (ORDER BY {col}) - 1 AS i,
                      cast(count(*) OVER () - 1 AS double) * {float(p)!r} AS pos
               FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col}))))"""


def top1(key: str) -> str:
    return (f"(SELECT {key} FROM s WHERE {key} IS NOT NULL GROUP BY {key} "
            f"ORDER BY {msum('revenue')} DESC, {key} LIMIT 1)")


FILTER_YEARS = [1996, 1998, 2000]
FILTER_REGIONS = ["AMERICA", "ASIA", "EUROPE"]
FILTER_CATEGORIES = ["Economy", "Large", "Promo"]


def _in(values) -> str:
    return ", ".join(repr(v) for v in values)


FILTERED = (f"f AS (SELECT * FROM s WHERE year IN ({_in(FILTER_YEARS)}) "
            f"AND region IN ({_in(FILTER_REGIONS)}) AND category IN ({_in(FILTER_CATEGORIES)}))")

Q["summary_stats"] = with_sales(f"""
SELECT {msum('revenue')} AS total_revenue, {msum('profit')} AS total_profit,
       count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
       {mavg('revenue')} AS avg_order_value, {ravg('profit_margin')} AS avg_profit_margin,
       {top1('category')} AS top_category, {top1('region')} AS top_region
FROM s""")

Q["filter_sales"] = with_sales("SELECT * FROM f", FILTERED)

Q["filter_options"] = with_sales("""
SELECT DISTINCT 'year' AS option, cast(year AS varchar) AS value FROM s WHERE year IS NOT NULL
UNION ALL SELECT DISTINCT 'region', region FROM s WHERE region IS NOT NULL
UNION ALL SELECT DISTINCT 'category', category FROM s WHERE category IS NOT NULL""")

Q["overview_cards"] = with_sales(f"""
SELECT {msum('revenue')} AS total_revenue, {msum('profit')} AS total_profit,
       {ravg('profit_margin')} AS avg_margin, count(*) AS orders,
       {mavg('revenue')} AS avg_order_value, count(DISTINCT customer_id) AS customers
FROM f""", FILTERED)

Q["monthly_sales_trend"] = with_sales(f"""
SELECT year_month, {msum('revenue')} AS revenue, {msum('profit')} AS profit, count(order_id) AS orders,
       cast(year_month || '-01' AS date) AS year_month_dt
FROM s WHERE year_month IS NOT NULL GROUP BY year_month""")

Q["yoy_growth"] = with_sales(f"""
SELECT year, total_revenue,
       (total_revenue - lag(total_revenue) OVER (ORDER BY year)) / nullif(lag(total_revenue) OVER (ORDER BY year), 0) AS growth
FROM (SELECT year, {msum('revenue')} AS total_revenue FROM s WHERE year IS NOT NULL GROUP BY year)""")

PRODUCT_METRICS = f"""
SELECT product, {msum('revenue')} AS revenue, {msum('profit')} AS profit,
       count(order_id) AS orders, {ravg('profit_margin')} AS avg_margin
FROM s WHERE product IS NOT NULL GROUP BY product"""

Q["top_products"] = with_sales(PRODUCT_METRICS + " ORDER BY revenue DESC, product LIMIT 10")

Q["bottom_products"] = with_sales(f"""
SELECT product, {msum('revenue')} AS revenue, {msum('profit')} AS profit
FROM s WHERE product IS NOT NULL GROUP BY product ORDER BY profit, product LIMIT 5""")

Q["category_performance"] = with_sales(f"""
SELECT *, {half_up('revenue / nullif(sum(revenue) OVER (), 0)', 4)} AS revenue_share
FROM (SELECT category, {msum('revenue')} AS revenue, {msum('profit')} AS profit,
             count(order_id) AS orders, {ravg('profit_margin')} AS avg_margin
      FROM s WHERE category IS NOT NULL GROUP BY category)""")

Q["city_performance"] = with_sales(f"""
SELECT region, city, {msum('revenue')} AS revenue FROM s
WHERE region IS NOT NULL AND city IS NOT NULL GROUP BY region, city
ORDER BY revenue DESC, region, city LIMIT 10""")

CUSTOMER_METRICS = f"""
SELECT customer_id, {msum('revenue')} AS total_revenue, count(order_id) AS total_orders,
       {mavg('revenue')} AS avg_order_value, {msum('profit')} AS total_profit
FROM s WHERE customer_id IS NOT NULL GROUP BY customer_id"""

Q["top_customers"] = with_sales(CUSTOMER_METRICS + " ORDER BY total_revenue DESC, customer_id LIMIT 10")

Q["segment_analysis"] = with_sales(f"""
SELECT *, {half_up('revenue / nullif(customers, 0)', 2)} AS revenue_per_customer
FROM (SELECT segment, {msum('revenue')} AS revenue, count(order_id) AS orders,
             count(DISTINCT customer_id) AS customers
      FROM s WHERE segment IS NOT NULL GROUP BY segment)""")

Q["monthly_avg_revenue"] = with_sales("""
SELECT month, month_name, cast(sum(rev) AS double) / cast(count(*) AS double) AS avg_revenue
FROM (SELECT year, month, month_name, sum(cast(revenue AS decimal(18,2))) AS rev
      FROM s WHERE year IS NOT NULL AND month IS NOT NULL AND month_name IS NOT NULL
      GROUP BY year, month, month_name)
GROUP BY month, month_name""")

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
Q["heatmap_data"] = with_sales(
    "SELECT month, month_name, "
    + ", ".join(f"{msum(chr(39).join(['CASE WHEN region = ', r, ' THEN revenue END']))} AS \"{r}\""
                for r in REGIONS)
    + " FROM s WHERE month IS NOT NULL AND month_name IS NOT NULL AND region IS NOT NULL"
      " GROUP BY month, month_name")

TIER = """CASE WHEN discount > -0.01 AND discount <= 0.0 THEN {a}
     WHEN discount > 0.0 AND discount <= 0.1 THEN {b}
     WHEN discount > 0.1 AND discount <= 0.2 THEN {c}
     WHEN discount > 0.2 AND discount <= 0.3 THEN {d} END"""
TIER_LABEL = TIER.format(a="'No Discount'", b="'5–10%'", c="'11–20%'", d="'21–30%'")
TIER_ORDER = TIER.format(a=1, b=2, c=3, d=4)

Q["discount_impact"] = with_sales(f"""
SELECT tier_order, discount_tier, {ravg('profit_margin')} AS avg_margin,
       {mavg('revenue')} AS avg_revenue, count(order_id) AS orders
FROM (SELECT *, {TIER_LABEL} AS discount_tier, {TIER_ORDER} AS tier_order FROM s)
WHERE discount_tier IS NOT NULL GROUP BY tier_order, discount_tier""")

Q["order_value_distribution"] = with_sales("SELECT revenue FROM s")

HIST = f"""
r AS (SELECT revenue FROM s WHERE revenue IS NOT NULL),
cp AS (SELECT {pct('r', 'revenue', 0.99)} AS cap),
k AS (SELECT revenue AS x FROM r WHERE revenue <= (SELECT cap FROM cp)),
st AS (SELECT min(x) AS lo0, max(x) AS hi0, {mavg('x')} AS mean_value, {pct('k', 'x', 0.5)} AS median_value FROM k),
st2 AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st),
st3 AS (SELECT *, (hi - lo) / 50.0 AS step, 50.0 / (hi - lo) AS norm FROM st2),
b0 AS (SELECT x, least(floor((x - lo) * norm), 49) AS i0, lo, hi, step FROM k, st3),
b1 AS (SELECT x, CASE WHEN x < (CASE WHEN i0 >= 50 THEN hi ELSE cast(i0 AS double) * step + lo END)
                      THEN i0 - 1 ELSE i0 END AS i1, lo, hi, step FROM b0),
b2 AS (SELECT CASE WHEN i1 <> 49 AND x >= (CASE WHEN i1 + 1 >= 50 THEN hi ELSE cast(i1 + 1 AS double) * step + lo END)
                   THEN i1 + 1 ELSE i1 END AS bin FROM b1),
cnt AS (SELECT cast(bin AS integer) AS bin, count(*) AS orders FROM b2 GROUP BY bin),
spine AS (SELECT cast(range AS integer) AS bin FROM range(50))"""

Q["order_histogram"] = with_sales("""
SELECT spine.bin, cast(spine.bin AS double) * step + lo AS bin_lower,
       CASE WHEN spine.bin + 1 >= 50 THEN hi ELSE cast(spine.bin + 1 AS double) * step + lo END AS bin_upper,
       coalesce(orders, 0) AS orders, cap AS clip_value, mean_value, median_value
FROM spine LEFT JOIN cnt ON spine.bin = cnt.bin, st3, cp WHERE lo0 IS NOT NULL""", HIST)

Q["customer_concentration"] = with_sales(f"""
SELECT {msum('total_revenue')} AS top_revenue, (SELECT {msum('revenue')} FROM s) AS total_revenue,
       {msum('total_revenue')} / nullif((SELECT {msum('revenue')} FROM s), 0) AS top_share
FROM ({CUSTOMER_METRICS} ORDER BY total_revenue DESC, customer_id LIMIT 10)""")


# --- RFM ------------------------------------------------------------------
from ledgerlens.functions.constants import NO_ACTION, SEGMENT_ACTIONS  # noqa: E402  (texts only)

RFM0 = f"""
rfm0 AS (
  SELECT customer_id,
         cast(datediff('day', max(date), (SELECT max(date) FROM s) + 1) AS integer) AS recency,
         count(order_id) AS frequency, {msum('revenue')} AS monetary
  FROM s WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


def _score(col: str, qs: list[str], reverse: bool) -> str:
    above = " + ".join(f"(CASE WHEN {col} > {q} THEN 1 ELSE 0 END)" for q in qs)
    return f"cast(4 - ({above}) AS integer)" if reverse else f"cast(1 + {above} AS integer)"


QR = [pct("rfm0", "recency", p) for p in (0.25, 0.5, 0.75)]
QM = [pct("rfm0", "monetary", p) for p in (0.25, 0.5, 0.75)]
RFM1 = f"""
rfm1 AS (
  SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank, count(*) OVER () AS n FROM rfm0),
rfm2 AS (
  SELECT customer_id, recency, frequency, monetary,
         {_score('recency', QR, True)} AS r_score,
         cast(1 + (CASE WHEN cast(f_rank AS double) > 1.0 + cast(n - 1 AS double) * 0.25 THEN 1 ELSE 0 END)
                + (CASE WHEN cast(f_rank AS double) > 1.0 + cast(n - 1 AS double) * 0.5 THEN 1 ELSE 0 END)
                + (CASE WHEN cast(f_rank AS double) > 1.0 + cast(n - 1 AS double) * 0.75 THEN 1 ELSE 0 END) AS integer) AS f_score,
         {_score('monetary', QM, False)} AS m_score
  FROM rfm1),
rfm3 AS (
  SELECT *, cast(r_score AS varchar) || cast(f_score AS varchar) || cast(m_score AS varchar) AS rfm_score,
         r_score + f_score + m_score AS rfm_total FROM rfm2)"""

#: Written out by hand per recency score, apart from the rules that the operators read.
SEGMENT_CASE = """CASE r_score
 WHEN 4 THEN CASE WHEN f_score = 4 THEN 'Champions' WHEN f_score = 3 THEN 'Loyal Customers' ELSE 'New Customers' END
 WHEN 3 THEN CASE WHEN f_score >= 3 THEN 'Loyal Customers' WHEN f_score = 2 THEN 'Potential Loyalist' ELSE 'Promising' END
 WHEN 2 THEN CASE WHEN f_score >= 3 THEN 'Need Attention' WHEN m_score >= 3 THEN 'About to Sleep' ELSE 'Hibernating' END
 ELSE CASE WHEN f_score >= 3 AND m_score >= 3 THEN 'At Risk' ELSE 'Lost' END END"""

RFM4 = f"rfm AS (SELECT *, {SEGMENT_CASE} AS segment FROM rfm3)"


def _sqlstr(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


ACTIONS = "acts(segment, action) AS (VALUES " + ", ".join(
    f"({_sqlstr(k)}, {_sqlstr(v)})" for k, v in SEGMENT_ACTIONS.items()) + ")"

Q["rfm_values"] = with_sales("SELECT * FROM rfm0", RFM0)
Q["rfm_scores"] = with_sales("SELECT * FROM rfm3", RFM0, RFM1)
Q["rfm_segments"] = with_sales("SELECT * FROM rfm", RFM0, RFM1, RFM4)
Q["rank_first"] = with_sales("SELECT customer_id, frequency, f_rank FROM rfm1", RFM0, RFM1)
Q["quantile_score"] = with_sales(f"""
SELECT customer_id, monetary, {QM[0]} AS q1, {QM[1]} AS q2, {QM[2]} AS q3,
       {_score('monetary', QM, False)} AS score FROM rfm0""", RFM0)

Q["segment_summary"] = with_sales(f"""
SELECT g.segment, customers,
       cast({half_up('cast(sr AS double) / cast(customers AS double)', 0)} AS integer) AS avg_recency,
       {half_up('cast(sf AS double) / cast(customers AS double)', 1)} AS avg_frequency,
       {half_up('am', 2)} AS avg_monetary, total_revenue,
       {half_up('cast(customers AS double) / cast(sum(customers) OVER () AS double) * 100.0', 1)} AS pct_customers,
       coalesce(acts.action, '{NO_ACTION}') AS action
FROM (SELECT segment, count(customer_id) AS customers, sum(recency) AS sr, sum(frequency) AS sf,
             {mavg('monetary')} AS am, {msum('monetary')} AS total_revenue
      FROM rfm GROUP BY segment) g LEFT JOIN acts ON g.segment = acts.segment""",
                                  RFM0, RFM1, RFM4, ACTIONS)

Q["rfm_grid"] = with_sales("SELECT r_score, " + ", ".join(
    f"coalesce({mavg(f'CASE WHEN f_score = {f} THEN monetary END')}, 0.0) AS f_{f}" for f in range(1, 5))
    + " FROM rfm GROUP BY r_score", RFM0, RFM1, RFM4)

Q["rfm_scatter"] = with_sales("""
SELECT customer_id, recency, frequency, monetary, segment,
       (monetary - (SELECT min(monetary) FROM rfm)) / nullif((SELECT max(monetary) FROM rfm) - (SELECT min(monetary) FROM rfm), 0) * 200.0 + 10.0 AS bubble_size
FROM rfm""", RFM0, RFM1, RFM4)

Q["segment_compare"] = with_sales(f"""
SELECT w.segment, coalesce(customers, 0) AS customers, avg_monetary
FROM (VALUES ('Champions'), ('Lost')) w(segment)
LEFT JOIN (SELECT segment, count(customer_id) AS customers, {mavg('monetary')} AS avg_monetary
           FROM rfm GROUP BY segment) g ON w.segment = g.segment""", RFM0, RFM1, RFM4)

Q["top_n"] = with_sales("""
SELECT customer_id, count(order_id) AS orders FROM s GROUP BY customer_id
ORDER BY orders DESC, customer_id LIMIT 15""")

Q["share_of_total"] = with_sales(f"""
SELECT *, {half_up('revenue / nullif(sum(revenue) OVER (), 0)', 6)} AS revenue_share
FROM (SELECT segment, region, {msum('revenue')} AS revenue FROM s GROUP BY segment, region)""")


# --- forecast ---------------------------------------------------------------
SERIES = """
ms0 AS (SELECT cast(year_month || '-01' AS date) AS ds, sum(cast(revenue AS decimal(18,2))) AS rev
        FROM s WHERE year_month IS NOT NULL GROUP BY year_month),
spine AS (SELECT cast(unnest(generate_series((SELECT min(ds) FROM ms0), (SELECT max(ds) FROM ms0), INTERVAL 1 MONTH)) AS date) AS ds),
ms AS (SELECT spine.ds, coalesce(cast(ms0.rev AS double), 0.0) AS y FROM spine LEFT JOIN ms0 ON spine.ds = ms0.ds)"""

TREND = """
tr AS (SELECT ds, y,
              CASE WHEN count(y) OVER w >= 6
                   THEN cast(sum(cast(y AS decimal(20,2))) OVER w AS double) / cast(count(y) OVER w AS double) END AS trend
       FROM ms WINDOW w AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))"""

DECOMP = f"""
d0 AS (SELECT ds, y, trend, y / nullif(trend, 0) AS detrended, cast(month(ds) AS integer) AS month FROM tr),
si0 AS (SELECT month, avg(detrended) AS sraw FROM d0 GROUP BY month),
si AS (SELECT month, {half_up('sraw / nullif(avg(sraw) OVER (), 0)', 12)} AS seasonal_index FROM si0),
dec AS (SELECT d0.ds, d0.y, d0.trend, d0.detrended, d0.month, si.seasonal_index AS seasonal,
               d0.detrended / nullif(si.seasonal_index, 0) AS residual
        FROM d0 LEFT JOIN si ON d0.month = si.month)"""



def significant(x: str, digits: int = 10) -> str:
    power = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"CASE WHEN {x} = 0 THEN {x} WHEN {power} >= 0 THEN floor({x} * pow(10.0::double, {power}) + 0.5) / pow(10.0::double, {power}) "
            f"ELSE floor({x} / pow(10.0::double, -{power}) + 0.5) * pow(10.0::double, -{power}) END")


FIT = f"""
fit0 AS (SELECT regr_slope(trend, x) AS slope0, regr_intercept(trend, x) AS intercept0, count(*) AS n_valid
        FROM (SELECT trend, cast(row_number() OVER (ORDER BY ds) - 1 AS double) AS x FROM dec WHERE trend IS NOT NULL)),
fit AS (SELECT {significant('slope0')} AS slope, {significant('intercept0')} AS intercept, n_valid FROM fit0)"""

FORECAST = f"""
st AS (SELECT max(ds) AS last_ds, {half_up('stddev_samp(residual)', 12)} AS sd FROM dec),
fut0 AS (SELECT h, cast(last_ds + to_months(h) AS date) AS ds, sd, slope, intercept, n_valid
         FROM st, fit, (SELECT unnest(generate_series(1, 6)) AS h)),
fut AS (SELECT fut0.ds,
               greatest(slope * cast(n_valid + h - 1 AS double) + intercept, 0.0) AS trend,
               CASE WHEN si.month IS NULL THEN 1.0 ELSE si.seasonal_index END AS seasonal, sd
        FROM fut0 LEFT JOIN si ON cast(month(fut0.ds) AS integer) = si.month),
fc AS (SELECT ds, y AS actual, trend, seasonal, trend * seasonal AS forecast,
              cast(NULL AS double) AS ci_lower, cast(NULL AS double) AS ci_upper FROM dec
       UNION ALL
       SELECT ds, cast(NULL AS double), trend, seasonal, trend * seasonal,
              greatest(trend * seasonal - trend * seasonal * sd, 0.0), trend * seasonal + trend * seasonal * sd
       FROM fut)"""

Q["monthly_series"] = with_sales("SELECT ds, y FROM ms", SERIES)
Q["centered_moving_average"] = with_sales("SELECT ds, y, trend FROM tr", SERIES, TREND)
Q["decompose"] = with_sales("SELECT * FROM dec", SERIES, TREND, DECOMP)
Q["seasonal_index"] = with_sales("SELECT * FROM si", SERIES, TREND, DECOMP)
Q["fit_trend"] = with_sales("SELECT * FROM fit", SERIES, TREND, DECOMP, FIT)
Q["forecast"] = with_sales("SELECT * FROM fc", SERIES, TREND, DECOMP, FIT, FORECAST)
Q["forecast_summary"] = with_sales(
    "SELECT ds, strftime(ds, '%b %Y') AS month_label, forecast, ci_lower, ci_upper FROM fc WHERE actual IS NULL",
    SERIES, TREND, DECOMP, FIT, FORECAST)


# --- KPI --------------------------------------------------------------------
#: (key, label, unit, target, warn, crit, higher is better), written out apart from the operators' table.
KPI_LIMITS = [
    ("monthly_revenue", "Monthly Revenue", "$", 145000.0, 0.85, 0.70, True),
    ("avg_order_value", "Avg Order Value", "$", 420.0, 0.90, 0.75, True),
    ("profit_margin", "Profit Margin %", "%", 0.26, 0.88, 0.75, True),
    ("order_count", "Monthly Orders", "", 330.0, 0.85, 0.70, True),
    ("discount_rate", "Avg Discount Rate", "%", 0.10, 1.20, 1.50, False),
]

FIXTURE_TARGETS = {"monthly_revenue": 30_000_000.0, "avg_order_value": 45_000.0,
                   "profit_margin": 0.40, "order_count": 700.0, "discount_rate": 0.10}

KPIS = f"""
rec AS (SELECT * FROM s WHERE date >= (SELECT max(date) FROM s) - INTERVAL 3 MONTH),
kpis AS (
  SELECT {msum('revenue')} / cast(greatest(count(DISTINCT year_month), 1) AS double) AS monthly_revenue,
         {mavg('revenue')} AS avg_order_value,
         {ravg('profit_margin')} AS profit_margin,
         cast(count(*) AS double) / cast(greatest(count(DISTINCT year_month), 1) AS double) AS order_count,
         {mavg('discount', 'decimal(20,8)')} AS discount_rate
  FROM rec)"""

CFG = "cfg(kpi_order, key, label, unit, target, warn_pct, crit_pct, higher_is_better) AS (VALUES " + ", ".join(
    f"({i + 1}, '{k}', '{lab}', '{u}', cast({FIXTURE_TARGETS.get(k, t)!r} AS double), {w!r}, {c!r}, {str(h).lower()})"
    for i, (k, lab, u, t, w, c, h) in enumerate(KPI_LIMITS)) + ")"


def classify_sql(v: str, t: str, w: str, c: str, h: str) -> str:
    ratio = f"(CASE WHEN {t} <> 0 THEN {v} / {t} ELSE 1.0 END)"
    return (f"(CASE WHEN {v} IS NULL THEN 'RED' WHEN {h} THEN "
            f"(CASE WHEN {ratio} >= {w} THEN 'GREEN' WHEN {ratio} >= {c} THEN 'YELLOW' ELSE 'RED' END) "
            f"ELSE (CASE WHEN {ratio} <= {w} THEN 'GREEN' WHEN {ratio} <= {c} THEN 'YELLOW' ELSE 'RED' END) END)")


ALERTS = f"""
kv AS (UNPIVOT kpis ON monthly_revenue, avg_order_value, profit_margin, order_count, discount_rate
       INTO NAME key VALUE value),
alerts AS (
  SELECT cfg.kpi_order, cfg.key, cfg.label, kv.value, cfg.target,
         {classify_sql('kv.value', 'cfg.target', 'cfg.warn_pct', 'cfg.crit_pct', 'cfg.higher_is_better')} AS status,
         CASE WHEN cfg.target <> 0 THEN (kv.value - cfg.target) / cfg.target * 100.0 END AS pct_vs_target,
         CASE WHEN cfg.target <> 0 THEN kv.value / cfg.target ELSE 1.0 END AS ratio,
         cfg.higher_is_better, cfg.unit
  FROM cfg JOIN kv ON cfg.key = kv.key)"""

Q["compute_kpis"] = with_sales("SELECT * FROM kpis", KPIS)
Q["kpi_alerts"] = with_sales("SELECT * FROM alerts", KPIS, CFG, ALERTS)
Q["classify_kpi"] = with_sales("SELECT key, value, target, ratio, status, pct_vs_target FROM alerts",
                               KPIS, CFG, ALERTS)
Q["kpi_alert_counts"] = with_sales("""
SELECT count(*) FILTER (WHERE status = 'RED') AS red, count(*) FILTER (WHERE status = 'YELLOW') AS yellow,
       count(*) FILTER (WHERE status = 'GREEN') AS green,
       coalesce(string_agg(CASE WHEN status = 'RED' THEN label END, ', ' ORDER BY kpi_order), '') AS red_labels
FROM alerts""", KPIS, CFG, ALERTS)

PARTS = """
parts AS (SELECT year_month, sum(cast(revenue AS decimal(18,2))) AS rev, count(revenue) AS rev_n, count(*) AS rows,
                 sum(cast(profit_margin AS decimal(18,4))) AS pm, count(profit_margin) AS pm_n,
                 sum(cast(discount AS decimal(20,8))) AS disc, count(discount) AS disc_n
          FROM s WHERE year_month IS NOT NULL GROUP BY year_month),
roll AS (SELECT year_month, count(*) OVER w AS months_in_window,
                cast(sum(rev) OVER w AS double) AS revenue_w, sum(rev_n) OVER w AS rev_n_w, sum(rows) OVER w AS rows_w,
                cast(sum(pm) OVER w AS double) AS pm_w, sum(pm_n) OVER w AS pm_n_w,
                cast(sum(disc) OVER w AS double) AS disc_w, sum(disc_n) OVER w AS disc_n_w
         FROM parts WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

Q["rolling_kpi_window"] = with_sales("SELECT * FROM roll", PARTS)

_HIST_COLS = ", ".join(
    f"{classify_sql(k, repr(FIXTURE_TARGETS.get(k, t)), repr(w), repr(c), str(h).lower())} AS {k}_status"
    for k, _, _, t, w, c, h in KPI_LIMITS)
Q["kpi_history"] = with_sales(f"""
SELECT *, {_HIST_COLS} FROM (
  SELECT year_month, revenue_w / cast(months_in_window AS double) AS monthly_revenue,
         revenue_w / nullif(cast(rev_n_w AS double), 0) AS avg_order_value,
         pm_w / nullif(cast(pm_n_w AS double), 0) AS profit_margin,
         cast(rows_w AS double) / cast(months_in_window AS double) AS order_count,
         disc_w / nullif(cast(disc_n_w AS double), 0) AS discount_rate
  FROM roll)""", PARTS)


# --- cleaning ---------------------------------------------------------------
RAW = """
rb AS (
  SELECT l_orderkey*7 + l_linenumber*13 + l_partkey AS k,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, c_mktsegment, o_orderdate, p_name, p_type, r_name, n_name,
         cast(l_quantity AS int) AS qty,
         floor(l_extendedprice/l_quantity*100+0.5)/100 AS up,
         floor(l_discount*100+0.5)*3/100 AS disc,
         cast(0.1 AS double)+l_tax+p_size/cast(200 AS double) AS margin
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey JOIN part ON l_partkey=p_partkey),
rc AS (SELECT *, floor(up*qty*(1-disc)*100+0.5)/100 AS rev FROM rb),
rd AS (SELECT *, floor(rev*margin*100+0.5)/100 AS prof, 0 AS dup FROM rc),
re AS (SELECT * FROM rd UNION ALL SELECT k,l_orderkey,l_linenumber,l_partkey,l_suppkey,o_custkey,c_mktsegment,o_orderdate,p_name,p_type,r_name,n_name,qty,up,disc,margin,rev,prof,1 FROM rd WHERE k%100=0),
raw AS (
  SELECT 'ORD-' || cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_partkey AS varchar) || '-' || cast(l_suppkey AS varchar) AS order_id,
         'CUST-' || cast(o_custkey AS varchar) AS customer_id,
         CASE WHEN k%50=3 THEN NULL ELSE c_mktsegment END AS segment,
         CASE WHEN k%97=11 THEN 'not-a-date' ELSE cast(cast(o_orderdate AS date) AS varchar) END AS date,
         p_name AS product,
         CASE WHEN k%60=5 OR (dup=1 AND k%200=0) THEN lower(p_type) ELSE p_type END AS category,
         r_name AS region,
         CASE WHEN k%50=29 THEN NULL ELSE n_name END AS city,
         CASE WHEN k%101=7 THEN '-1' WHEN k%103=9 THEN 'n/a' ELSE cast(qty AS varchar) END AS quantity,
         cast(up AS varchar) AS unit_price,
         CASE WHEN k%50=17 THEN NULL ELSE cast(disc AS varchar) END AS discount,
         cast(rev AS varchar) AS revenue, cast(prof AS varchar) AS profit
  FROM re)"""


def _num(c: str) -> str:
    return f"(CASE WHEN isnan(try_cast({c} AS double)) THEN NULL ELSE try_cast({c} AS double) END)"


TYPED = f"""
typed AS (
  SELECT order_id, customer_id, segment, cast(try_strptime(date, '%Y-%m-%d') AS date) AS date,
         product, category, region, city,
         CASE WHEN {_num('quantity')} = floor({_num('quantity')}) AND abs({_num('quantity')}) < 1e18
              THEN cast({_num('quantity')} AS bigint) END AS quantity,
         {_num('unit_price')} AS unit_price, {_num('discount')} AS discount,
         {_num('revenue')} AS revenue, {_num('profit')} AS profit
  FROM raw)"""

MODE = """
seg_mode AS (SELECT segment AS mode FROM typed WHERE segment IS NOT NULL GROUP BY segment
             ORDER BY count(*) DESC, segment LIMIT 1)"""

MISSING = """
filled AS (
  SELECT order_id, customer_id, coalesce(segment, (SELECT mode FROM seg_mode)) AS segment, date, product, category,
         region, coalesce(city, 'Unknown') AS city, quantity, unit_price, coalesce(discount, 0.0) AS discount,
         revenue, profit
  FROM typed),
missing AS (SELECT * FROM filled WHERE revenue IS NOT NULL AND unit_price IS NOT NULL AND quantity IS NOT NULL
            AND date IS NOT NULL)"""

DEDUP = "dedup AS (SELECT DISTINCT * FROM missing)"

TITLE = ("array_to_string(list_transform(string_split(lower(category), ' '), "
         "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")

QUALITY = f"""
quality AS (
  SELECT order_id, customer_id, segment, date, product, {TITLE} AS category, region, city, quantity,
         unit_price, discount, floor(unit_price * quantity * (1.0 - discount) * 100 + 0.5) / 100 AS revenue, profit
  FROM dedup WHERE quantity > 0)"""


def features(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, cast(year(date) AS integer) AS year, cast(month(date) AS integer) AS month,
         strftime(date, '%b') AS month_name, cast(quarter(date) AS integer) AS quarter,
         strftime(date, '%Y-%m') AS year_month,
         floor(profit / nullif(revenue, 0) * 10000 + 0.5) / 10000 AS profit_margin
  FROM {src})"""


CLEAN = [RAW, TYPED, MODE, MISSING, DEDUP, QUALITY, features("quality", "cleaned")]


def with_raw(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


from ledgerlens.functions.constants import NULL_TOKENS  # noqa: E402

_RAW_COLS = ["order_id", "customer_id", "segment", "date", "product", "category", "region", "city", "quantity",
             "unit_price", "discount", "revenue", "profit"]


def _tok(c: str) -> str:
    return f"CASE WHEN {c} IN ({', '.join(_sqlstr(t) for t in NULL_TOKENS)}) THEN NULL ELSE {c} END"


CSV_NAMES = {"revenue": "Revenue ", "profit": "Profit"}
Q["load_sales"] = with_raw("SELECT " + ", ".join(
    f'{_tok(c)} AS "{CSV_NAMES.get(c, c)}"' for c in _RAW_COLS) + " FROM raw", RAW)
_KEY = "(cast(split_part(order_id, '-', 2) AS bigint) + cast(split_part(order_id, '-', 3) AS bigint))"
_SHORT, _STRAY = f"{_KEY} % 37 = 5", f"{_KEY} % 37 <> 5 AND {_KEY} % 41 = 7"
LOADED = ("ragged AS (SELECT * FROM raw),\nkept AS (SELECT * REPLACE (CASE WHEN " + _SHORT + " THEN NULL ELSE revenue END AS revenue, "
          "CASE WHEN " + _SHORT + f" THEN NULL ELSE profit END AS profit) FROM ragged WHERE NOT ({_STRAY}))")
Q["load_ragged_sales"] = with_raw("SELECT " + ", ".join(
    f'{_tok(c)} AS "{CSV_NAMES.get(c, c)}"' for c in _RAW_COLS) + " FROM kept", RAW, LOADED)
Q["load_bad_rows"] = with_raw(f"SELECT order_id, {len(_RAW_COLS) + 1} AS fields, {len(_RAW_COLS)} AS expected "
                              f"FROM raw WHERE {_STRAY}", RAW)
Q["standardize_columns"] = with_raw("SELECT " + ", ".join(f"{_tok(c)} AS {c}" for c in _RAW_COLS)
                                    + " FROM raw", RAW)
Q["fix_dtypes"] = with_raw("SELECT * FROM typed", RAW, TYPED)
Q["mode_value"] = with_raw("SELECT * FROM seg_mode", RAW, TYPED, MODE)
Q["handle_missing"] = with_raw("SELECT * FROM missing", RAW, TYPED, MODE, MISSING)
Q["remove_duplicates"] = with_raw("SELECT * FROM dedup", RAW, TYPED, MODE, MISSING, DEDUP)
Q["fix_quality_issues"] = with_raw("SELECT * FROM quality", RAW, TYPED, MODE, MISSING, DEDUP, QUALITY)
Q["clean_sales"] = with_raw("SELECT * FROM cleaned", *CLEAN)
Q["write_clean"] = Q["clean_sales"]
Q["engineer_features"] = with_sales("""
SELECT order_id, date, year, month, month_name, quarter, year_month, profit, revenue, profit_margin FROM s""")

Q["cleaning_audit"] = with_raw("""
SELECT 1 AS step_no, 'handle_missing' AS step, (SELECT count(*) FROM filled) AS rows_before,
       (SELECT count(*) FROM missing) AS rows_after
UNION ALL SELECT 2, 'remove_duplicates', (SELECT count(*) FROM missing), (SELECT count(*) FROM dedup)
UNION ALL SELECT 3, 'fix_quality_issues', (SELECT count(*) FROM dedup), (SELECT count(*) FROM quality)""",
                               RAW, TYPED, MODE, MISSING, DEDUP, QUALITY) \
    .replace("\nSELECT 1 AS step_no", "\nSELECT *, rows_before - rows_after AS rows_dropped FROM (\nSELECT 1 AS step_no") + ")"

_CLEANED_RAGGED = RAW.replace("raw AS (", "ragged AS (") + ",\n" + LOADED.split(",\n", 1)[1].replace("kept AS", "raw AS", 1)
Q["load_audit"] = Q["cleaning_audit"].replace(RAW, _CLEANED_RAGGED).replace(
    "(\nSELECT 1 AS step_no, 'handle_missing' AS step,",
    "(\nSELECT -1 AS step_no, 'load_sales' AS step, (SELECT count(*) FROM ragged) AS rows_before, (SELECT count(*) FROM raw) AS rows_after\n"
    f"UNION ALL SELECT 0, 'fill_short_rows', (SELECT count(*) FROM ragged WHERE {_SHORT}), (SELECT count(*) FROM ragged WHERE {_SHORT})\n"
    "UNION ALL SELECT 1, 'handle_missing',")

_CLEAN_COLS = ["order_id", "customer_id", "segment", "date", "product", "category", "region", "city", "quantity",
               "unit_price", "discount", "revenue", "profit", "year", "month", "month_name", "quarter",
               "year_month", "profit_margin"]
Q["data_quality_report"] = with_raw(
    """
SELECT * FROM (
  SELECT 'rows' AS metric, cast(NULL AS varchar) AS column_name, cast(count(*) AS double) AS num_value,
         cast(NULL AS varchar) AS str_value FROM cleaned
  UNION ALL SELECT 'columns', NULL, """ + f"{float(len(_CLEAN_COLS))}" + """, NULL
  UNION ALL SELECT 'date_min', 'date', NULL, cast(min(date) AS varchar) FROM cleaned
  UNION ALL SELECT 'date_max', 'date', NULL, cast(max(date) AS varchar) FROM cleaned
  UNION ALL SELECT 'duplicates', NULL, cast((SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS double), NULL
  UNION ALL SELECT 'revenue_min', 'revenue', min(revenue), NULL FROM cleaned
  UNION ALL SELECT 'revenue_max', 'revenue', max(revenue), NULL FROM cleaned
""" + "".join(f"  UNION ALL SELECT 'nulls', '{c}', cast(count(*) FILTER (WHERE {c} IS NULL) AS double), NULL FROM cleaned\n"
              for c in _CLEAN_COLS) + ") WHERE metric <> 'nulls' OR num_value > 0", *CLEAN)


# --- insights ---------------------------------------------------------------
INSIGHTS = f"""
mar AS ({Q['monthly_avg_revenue'].split(FEATURES, 1)[1].strip()}),
reg AS (SELECT region, {msum('revenue')} AS revenue FROM s WHERE region IS NOT NULL GROUP BY region),
cat AS (SELECT category, {msum('revenue')} AS revenue, {ravg('profit_margin')} AS avg_margin
        FROM s WHERE category IS NOT NULL GROUP BY category),
tp AS ({PRODUCT_METRICS} ORDER BY revenue DESC, product LIMIT 1),
di AS (SELECT tier_order, {ravg('profit_margin')} AS avg_margin
       FROM (SELECT *, {TIER_ORDER} AS tier_order FROM s) WHERE tier_order IS NOT NULL GROUP BY tier_order),
cc AS (SELECT {msum('total_revenue')} AS top_revenue,
              {msum('total_revenue')} / nullif((SELECT {msum('revenue')} FROM s), 0) AS top_share
       FROM ({CUSTOMER_METRICS} ORDER BY total_revenue DESC, customer_id LIMIT 10)),
yy AS (SELECT year, {msum('revenue')} AS total_revenue FROM s WHERE year IS NOT NULL GROUP BY year ORDER BY year DESC LIMIT 2),
ins AS (
  (SELECT 1 AS no, 'peak_month' AS name, month_name AS subject, cast(NULL AS varchar) AS subject2,
          avg_revenue AS value, cast(NULL AS double) AS value2 FROM mar ORDER BY avg_revenue DESC, month LIMIT 1)
  UNION ALL
  (SELECT 2, 'region_performance', region,
          (SELECT region FROM reg ORDER BY revenue, region DESC LIMIT 1), revenue,
          (SELECT revenue FROM reg ORDER BY revenue, region DESC LIMIT 1) FROM reg ORDER BY revenue DESC, region LIMIT 1)
  UNION ALL
  (SELECT 3, 'best_margin_category', category, NULL, avg_margin, NULL FROM cat
   ORDER BY avg_margin DESC NULLS LAST, revenue DESC, category LIMIT 1)
  UNION ALL
  (SELECT 4, 'top_product', product, NULL, revenue, cast(orders AS double) FROM tp)
  UNION ALL
  (SELECT 5, 'discount_impact', 'No Discount', '21–30%',
          max(CASE WHEN tier_order = 1 THEN avg_margin END) - max(CASE WHEN tier_order = 4 THEN avg_margin END), NULL
   FROM di HAVING count(*) FILTER (WHERE tier_order = 1) > 0 AND count(*) FILTER (WHERE tier_order = 4) > 0)
  UNION ALL
  (SELECT 6, 'customer_concentration', NULL, NULL, top_share, top_revenue FROM cc)
  UNION ALL
  (SELECT 7, 'yoy_growth', cast(min(year) AS varchar), cast(max(year) AS varchar),
          (arg_max(total_revenue, year) - arg_min(total_revenue, year)) / nullif(arg_min(total_revenue, year), 0), NULL
   FROM yy HAVING count(*) >= 2))"""

Q["insights"] = with_sales("SELECT * FROM ins", INSIGHTS)
_WRITTEN = """
ss AS ({summary}), dd AS ({discount}),
rep AS (SELECT 'insights' AS table_name, name AS key, unnest(['value', 'value2']) AS measure, unnest([value, value2]) AS value FROM ins
  UNION ALL SELECT 'summary_stats', top_region, unnest(['total_revenue', 'total_profit', 'total_orders', 'unique_customers']),
    unnest([total_revenue, total_profit, CAST(total_orders AS DOUBLE), CAST(unique_customers AS DOUBLE)]) FROM ss
  UNION ALL SELECT 'discount_impact', discount_tier, unnest(['avg_margin', 'avg_revenue', 'orders']),
    unnest([avg_margin, avg_revenue, CAST(orders AS DOUBLE)]) FROM dd)"""
Q["write_report"] = with_sales("SELECT * FROM rep", INSIGHTS, _WRITTEN.format(
    summary=_nested(Q["summary_stats"]), discount=_nested(Q["discount_impact"])))

_D0 = "coalesce('$' || format('{{:,.0f}}', {0}), 'n/a')"
_P1 = "coalesce(format('{{:.1f}}', {0} * 100) || '%', 'n/a')"
Q["insight_text"] = with_sales(f"""
SELECT no, CASE no
 WHEN 1 THEN '1. Peak month: ' || s || ' earns the most on average. Plan stock, campaigns and staff for it.'
 WHEN 2 THEN '2. Regions: ' || s || ' comes first with ' || {_D0.format('value')} || ', ' || s2 || ' last with '
             || {_D0.format('value2')} || '. Look into delivery and demand in the last one.'
 WHEN 3 THEN '3. Margin: ' || s || ' has the best mean margin, ' || {_P1.format('value')} || '. Put it first in cross-selling.'
 WHEN 4 THEN '4. Product: ' || s || ' brings in ' || {_D0.format('value')} || ' with '
             || coalesce(format('{{:,.0f}}', value2), 'n/a') || ' orders. Keep it in stock.'
 WHEN 5 THEN '5. Discounts: margins of the highest tier are ' || {_P1.format('value')}
             || ' below those without discount. Keep discounts low outside clearances.'
 WHEN 6 THEN '6. Customers: the top 10 make ' || {_P1.format('value')} || ' of revenue, ' || {_D0.format('value2')}
             || '. Look after these accounts.'
 WHEN 7 THEN '7. Growth: revenue changed by ' || {_P1.format('value')} || ' from ' || s || ' to ' || s2 || '. '
             || CASE WHEN value > 0 THEN 'Invest in new customers.' ELSE 'Check prices and lost customers.' END
 END AS text
FROM (SELECT *, coalesce(subject, 'n/a') AS s, coalesce(subject2, 'n/a') AS s2 FROM ins)""", INSIGHTS)

Q["kpi_display"] = with_sales("""
SELECT kpi_order, key, label, status,
  coalesce(CASE unit WHEN '$' THEN '$' || format('{:,.2f}', value) WHEN '%' THEN format('{:,.1f}', value * 100) || '%'
           ELSE format('{:,.1f}', value) END, 'n/a') AS display_value,
  coalesce(CASE unit WHEN '$' THEN '$' || format('{:,.2f}', target) WHEN '%' THEN format('{:,.1f}', target * 100) || '%'
           ELSE format('{:,.1f}', target) END, 'n/a') AS display_target,
  coalesce(format('{:+.1f}', pct_vs_target) || '%', 'n/a') AS display_pct
FROM alerts""", KPIS, CFG, ALERTS)

Q["kpi_history_stream"] = Q["kpi_history"]


# --- dashboard flow: the same SQL over the filtered rows ------------------------------
def with_filtered_sales(body: str, *ctes: str) -> str:
    base = FEATURES.replace("\ns AS (", "\ns0 AS (", 1)
    filt = (f"\ns AS (SELECT * FROM s0 WHERE year IN ({_in(FILTER_YEARS)}) "
            f"AND region IN ({_in(FILTER_REGIONS)}) AND category IN ({_in(FILTER_CATEGORIES)}))")
    return "WITH " + SALES + "," + base + "," + filt + "".join("," + c for c in ctes) + "\n" + body


Q["filtered_segment_summary"] = with_filtered_sales("") + _body(Q["segment_summary"])
Q["filtered_forecast_summary"] = with_filtered_sales("") + _body(Q["forecast_summary"])
Q["filtered_kpi_alerts"] = with_filtered_sales("") + _body(Q["kpi_alerts"])

# reports from the cube: the same tables as from the facts
for _report in ("summary_stats", "region_performance", "segment_analysis", "category_performance", "city_performance",
                "heatmap_data", "discount_impact"):
    Q[f"cube_{_report}"] = Q[_report]
Q["cube_filtered_overview_cards"] = Q["overview_cards"]


def filtered_sql(q: str) -> str:
    """A report's SQL over the filtered rows."""
    return with_sales("", FILTERED).rstrip() + _body(q).replace("FROM s ", "FROM f ")


Q["cube_filtered_monthly_trend"] = filtered_sql(Q["monthly_sales_trend"])
Q["cube_filtered_segment_analysis"] = filtered_sql(Q["segment_analysis"])
Q["sketched_customers"] = with_sales("""
SELECT region, count(DISTINCT customer_id) AS customers, true AS within_bound FROM s WHERE region IS NOT NULL GROUP BY region""")
Q["rewrite_years"] = Q["write_clean"]
Q["kpis_from_days"] = Q["compute_kpis"]
Q["kpi_alerts_from_days"] = Q["kpi_alerts"]
Q["remove_duplicates_by_fingerprint"] = Q["remove_duplicates"]
Q["bucketed_star_join"] = "WITH " + SALES + "\nSELECT * FROM sales"
Q["bucketed_region_performance"] = Q["region_performance"]
Q["sketched_quartiles"] = with_sales(" UNION ALL ".join(
    f"SELECT cast({p} AS double) AS quartile, {QM[i]} AS edge, true AS within_bound" for i, p in enumerate((0.25, 0.5, 0.75))), RFM0)
