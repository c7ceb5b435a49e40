"""RFM customer segmentation: recency, frequency, monetary values, quartile
scores, named segments and the per-segment summary.

Scaling notes
* Per-customer values are one grouped aggregation (partially aggregated per
  task, so a customer with a third of all rows costs nothing extra).
* Recency and monetary edges are exact quartiles from ``exact_percentiles``
  (ranked value counts), never a collect of all customers; with ``accuracy`` they
  come from quantile sketches.
* The frequency score needs the order of all customers by (frequency, customer_id)
  only at three ranks: those come from the counts per frequency, and customers are
  put in order inside the frequencies that such a rank cuts (``frequency_cuts``).
  ``rank_first`` gives every customer's rank, by ``global_row_number``: range
  partitioning keeps every task bounded even when most customers share one frequency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.constants import (
    DEFAULT_SEGMENT, NO_ACTION, SEGMENT_ACTIONS, SEGMENT_RULES,
)
from ledgerlens.functions.exprs import half_up, money_avg, money_sum, safe_div
from ledgerlens.operators.eda import partial_sums
from ledgerlens.sources.files import checkpoint_table
from ledgerlens.operators.stats import (
    approx_percentiles, exact_percentiles_multi, global_row_number, range_numbered, score_by_edges,
)

QUARTILES = [0.25, 0.5, 0.75]


def rfm_values(df: DataFrame, snapshot_date: str | None = None, parts: DataFrame | None = None) -> DataFrame:
    """customer_id, recency (days from last purchase to the snapshot),
    frequency (rows), monetary (revenue). Snapshot defaults to max(date)+1.

    The per-customer aggregate is written once (or given as ``parts``, see
    ``eda.partial_sums``): the last date of all rows, those without a customer too,
    comes from it, so the facts are scanned once.
    """
    g = partial_sums(df, ["customer_id"]).select("customer_id", "last_date", "orders", "rev") if parts is None else parts
    if snapshot_date is None:
        g = checkpoint_table(g, "rfm_customers") if parts is None else g
        snap = g.agg(F.date_add(F.max("last_date"), 1)).scalar()
    else:
        snap = F.to_date(F.lit(snapshot_date))
    return g.where(F.col("customer_id").isNotNull()).select(
        "customer_id", F.datediff(snap, F.col("last_date")).alias("recency"), F.col("orders").alias("frequency"),
        F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("monetary"))


def quartile_edges(rfm: DataFrame, cols: list[str], accuracy: float | None = None):
    """Scalar struct (q0, q1, ...) of the quartile edges of ``cols``, one after the other: exact, or with
    ``accuracy`` values whose ranks are off by that share of all customers at most (one scan, nothing written)."""
    specs = [(c, p) for c in cols for p in QUARTILES]
    q = exact_percentiles_multi(rfm, specs) if accuracy is None else approx_percentiles(rfm, specs, accuracy)
    return q.select(F.struct(*q.columns)).scalar()


def rank_first(rfm: DataFrame) -> DataFrame:
    """Rank 1..n by (frequency, customer_id): pandas ``rank(method='first')``
    on customers ordered by id."""
    return global_row_number(rfm, ["frequency", "customer_id"], "f_rank")


def frequency_cuts(rfm: DataFrame, q: int = 4) -> DataFrame:
    """One row, ``cuts``: for each of the ``q - 1`` inner edges of ``qcut(rank)`` the last customer below it, as
    (frequency, customer_id) in the order of ``rank_first``; a null id stands for all customers of that frequency.

    Ranks run on over the counts per frequency (``k`` different frequencies take k * (k + 1) / 2 rows of facts at
    least, so they are few at any size). Only customers of a frequency that an edge cuts are put in order, in
    ranges, and numbered in the one range that holds the edge.
    """
    counts = rfm.groupBy("frequency").agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.select("frequency", "c", (F.sum("c").over(Window.orderBy("frequency")) - F.col("c")).alias("start"),
                           F.sum("c").over(Window.partitionBy()).alias("n"))
    lasts = F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.lit(1.0) + (F.col("n") - 1).cast("double") * F.lit(j / q))
                               .alias("last")) for j in range(1, q)])
    edges = (ranked.select("frequency", "c", "start", F.explode(lasts).alias("e"))
             .where((F.col("start") < F.col("e.last")) & (F.col("e.last") <= F.col("start") + F.col("c")))
             .select("frequency", "e.j", "c", (F.col("e.last") - F.col("start")).alias("place")))
    cut = edges.where("place < c").select("frequency", "j", "place")
    inside = rfm.select("frequency", "customer_id").join(F.broadcast(cut.select("frequency").distinct()),   # q - 1 rows
                                                         "frequency", "left_semi")
    ranged = range_numbered(inside, ["frequency", "customer_id"], "frequency_edges")
    before = Window.partitionBy("frequency").orderBy("_pid")
    sums = ranged.groupBy("frequency", "_pid").agg(F.count(F.lit(1)).alias("s")).select(
        "frequency", "_pid", "s", (F.sum("s").over(before) - F.col("s")).alias("off"))
    there = (sums.join(F.broadcast(cut), "frequency")
             .where((F.col("off") < F.col("place")) & (F.col("place") <= F.col("off") + F.col("s")))
             .select("frequency", "_pid", "j", (F.col("place") - F.col("off")).alias("here")))
    numbered = ranged.join(F.broadcast(there), ["frequency", "_pid"]).withColumn(
        "no", F.row_number().over(Window.partitionBy("j").orderBy("customer_id")))
    found = numbered.where("no = here").select("j", "customer_id")
    return (edges.select("j", "frequency").join(found, "j", "left")
            .agg(F.array_sort(F.collect_list(F.struct("j", "frequency", "customer_id"))).alias("cuts")))


def quantile_score(rfm: DataFrame, col: str = "monetary", reverse: bool = False,
                   accuracy: float | None = None) -> DataFrame:
    """Quartile score 1..4 of ``col`` (qcut with right-closed bins), with the edges (see ``quartile_edges``)."""
    e = quartile_edges(rfm, [col], accuracy)
    d = rfm.select("customer_id", col, e.alias("e"))
    edges = [F.col(f"e.q{i}") for i in range(3)]
    return d.select("customer_id", col, *[c.alias(f"q{i + 1}") for i, c in enumerate(edges)],
                    score_by_edges(F.col(col), edges, reverse).cast("int").alias("score"))


def rfm_scores(rfm: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Adds r_score (4 = most recent), f_score (by frequency rank), m_score,
    rfm_score ('rfm' digits) and rfm_total; ``accuracy`` as in ``quartile_edges``."""
    edges = quartile_edges(rfm, ["recency", "monetary"], accuracy)
    scored = rfm.select("*", edges.alias("_e"), frequency_cuts(rfm).scalar().alias("_c"))
    r = score_by_edges(F.col("recency"), [F.col(f"_e.q{i}") for i in range(3)], reverse=True)
    m = score_by_edges(F.col("monetary"), [F.col(f"_e.q{i}") for i in range(3, 6)])
    f = F.lit(1)
    for c in [F.get("_c", i) for i in range(3)]:
        beyond = (F.col("frequency") > c["frequency"]) | ((F.col("frequency") == c["frequency"])
                                                          & (F.col("customer_id") > c["customer_id"]))
        f = f + F.when(beyond, 1).otherwise(0)
    r, f, m = r.cast("int"), f.cast("int"), m.cast("int")
    return scored.select(
        *[F.col(c) for c in rfm.columns],
        r.alias("r_score"), f.alias("f_score"), m.alias("m_score"),
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_score"),
        (r + f + m).alias("rfm_total"))


def segment_expr(r="r_score", f="f_score", m="m_score") -> F.Column:
    """The segment rule cascade as one CASE expression (first match wins)."""
    r, f, m = F.col(r), F.col(f), F.col(m)
    out = None
    for name, (rl, rh), (fl, fh), (ml, mh) in SEGMENT_RULES:
        cond = r.between(rl, rh) & f.between(fl, fh) & m.between(ml, mh)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(DEFAULT_SEGMENT))


def rfm_segments(scored: DataFrame) -> DataFrame:
    return scored.withColumn("segment", segment_expr())


def compute_rfm(df: DataFrame, snapshot_date: str | None = None, parts: DataFrame | None = None,
                accuracy: float | None = None) -> DataFrame:
    """Values, scores and segment for every customer. The per-customer sums that all steps
    read are written once (or given as ``parts``): the fact table is aggregated exactly once."""
    if parts is None:
        parts = checkpoint_table(partial_sums(df, ["customer_id"]), "rfm_customers")
    return rfm_segments(rfm_scores(rfm_values(df, snapshot_date, parts), accuracy))


def segment_actions(spark) -> DataFrame:
    """The 11-row segment -> action table (fixed size: broadcast)."""
    return spark.createDataFrame(list(SEGMENT_ACTIONS.items()), "segment string, action string")


def segment_summary(rfm: DataFrame) -> DataFrame:
    g = (rfm.groupBy("segment")
         .agg(F.count("customer_id").alias("customers"),
              F.avg("recency").alias("_r"), F.avg("frequency").alias("_f"),
              money_avg("monetary").alias("_m"), money_sum("monetary").alias("total_revenue")))
    total = F.sum("customers").over(Window.partitionBy())
    acts = F.broadcast(segment_actions(rfm.sparkSession))
    return (g.join(acts, "segment", "left")
            .select("segment", "customers",
                    half_up("_r", 0).cast("int").alias("avg_recency"),
                    half_up("_f", 1).alias("avg_frequency"),
                    half_up("_m", 2).alias("avg_monetary"),
                    "total_revenue",
                    half_up(safe_div(F.col("customers"), total) * F.lit(100.0), 1).alias("pct_customers"),
                    F.coalesce(F.col("action"), F.lit(NO_ACTION)).alias("action"))
            .orderBy(F.col("total_revenue").desc(), "segment"))


def rfm_grid(rfm: DataFrame) -> DataFrame:
    """Mean monetary by r_score (rows) x f_score 1..4 (columns f_1..f_4), missing -> 0."""
    aggs = [F.coalesce(money_avg(F.when(F.col("f_score") == f, F.col("monetary"))), F.lit(0.0)).alias(f"f_{f}")
            for f in range(1, 5)]
    return rfm.groupBy("r_score").agg(*aggs).orderBy("r_score")


def rfm_scatter(rfm: DataFrame) -> DataFrame:
    """Per customer: recency, frequency, segment and a bubble size
    ``(monetary - min) / (max - min) * 200 + 10`` (null when all equal)."""
    mm = rfm.agg(F.struct(F.min("monetary").alias("lo"), F.max("monetary").alias("hi"))).scalar()
    d = rfm.select("customer_id", "recency", "frequency", "monetary", "segment", mm.alias("_mm"))
    size = safe_div(F.col("monetary") - F.col("_mm.lo"), F.col("_mm.hi") - F.col("_mm.lo")) * F.lit(200.0) + F.lit(10.0)
    return d.select("customer_id", "recency", "frequency", "monetary", "segment", size.alias("bubble_size"))


def segment_compare(rfm: DataFrame, segments: tuple[str, ...] = ("Champions", "Lost")) -> DataFrame:
    """Customers and mean monetary for the given segments; absent segments
    get 0 customers and a null mean."""
    spark = rfm.sparkSession
    wanted = spark.createDataFrame([(s,) for s in segments], "segment string")
    g = (rfm.where(F.col("segment").isin(list(segments))).groupBy("segment")
         .agg(F.count("customer_id").alias("customers"), money_avg("monetary").alias("avg_monetary")))
    return (wanted.join(g, "segment", "left")
            .select("segment", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                    "avg_monetary"))
