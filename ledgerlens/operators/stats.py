"""Shared statistical operators: top-n, shares, exact quantiles, global ranks,
quantile scores, centred moving averages and equal-width histograms.

Two of them are global by nature and are written so that no task or driver
ever holds the whole input:

* ``exact_percentiles``: rows collapse to distinct values with counts, which are
  ranked in value ranges with offsets. Result equals linear-interpolation
  percentiles, by the same plan at every size.
* ``global_row_number``: range-partition on the sort key (balanced even when
  one key value is hot, because the key includes a unique tie-breaker), number
  rows inside each partition, and add the row counts of earlier partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.constants import HISTOGRAM_BINS


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows by ``order`` (planned as TakeOrderedAndProject: a
    per-task top-n, then a merge of at most tasks*n rows)."""
    return df.orderBy(*order).limit(n)


def share_of_total(df: DataFrame, col: str, name: str, digits: int | None = 4) -> DataFrame:
    """``col / sum(col)`` over all rows of an already-aggregated (small) table."""
    from ledgerlens.functions.exprs import half_up, safe_div
    share = safe_div(F.col(col), F.sum(col).over(Window.partitionBy()))
    return df.withColumn(name, half_up(share, digits) if digits is not None else share)


# ---------------------------------------------------------------------------
# exact percentiles
# ---------------------------------------------------------------------------

def interpolate(n: Column, p: float, v_lo: Column, v_hi: Column) -> Column:
    """Linear interpolation between the values at ranks floor/ceil((n-1)p)."""
    pos = (n - F.lit(1)).cast("double") * F.lit(float(p))
    lower, higher = F.floor(pos), F.ceil(pos)
    return (F.when(n == 0, F.lit(None).cast("double"))
            .when((lower == higher) | (v_lo == v_hi), v_lo)
            .otherwise((higher - pos) * v_lo + (pos - lower) * v_hi))


def range_numbered(df: DataFrame, order_cols: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order_cols`` with its range number ``_pid``.

    The numbers are written with the rows, so that counts and numbering read the
    same ranges (a re-run range exchange could sample differently) and a lost
    executor re-reads files.
    """
    from ledgerlens.sources.files import checkpoint_table
    return checkpoint_table(df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()), name)


def value_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(j, value, c, start, end, n): per column ``cols[j]``, every distinct value with
    its count, the ranks (from 0) that it takes, and the number of values. Nulls and
    NaN are left out.

    One scan of ``df``: rows collapse to (value, count) in a partial aggregation.
    The distinct values are written in ranges; cumulative counts are taken inside a
    range and shifted by the sums of the ranges before it (one row per range and
    column). No task sees more than one range, at any size.
    """
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("value")) for j, c in enumerate(cols)])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*")
              .where(F.col("value").isNotNull() & ~F.isnan("value"))
              .groupBy("j", "value").agg(F.count(F.lit(1)).alias("c")))
    ranged = range_numbered(counts, ["j", "value"], "value_counts")
    sums = ranged.groupBy("j", "_pid").agg(F.sum("c").alias("s"))
    before = Window.partitionBy("j").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("j", "_pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"),
                          F.sum("s").over(Window.partitionBy("j")).alias("n"))
    inside = Window.partitionBy("_pid", "j").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("cum", F.sum("c").over(inside))
    # at most one row per range and column: safe to broadcast
    return local.join(F.broadcast(offsets), ["j", "_pid"]).select(
        "j", "value", "c", (F.col("off") + F.col("cum") - F.col("c")).alias("start"),
        (F.col("off") + F.col("cum") - 1).alias("end"), "n")


def percentiles_of(ranks: DataFrame, specs: list[tuple[int, float]], prefix: str = "q") -> DataFrame:
    """1-row DataFrame ``{prefix}0..``: the percentile of each (column number,
    probability), linearly interpolated, from ``value_ranks``."""
    picks = []
    for i, (j, p) in enumerate(specs):
        mine, pos = F.col("j") == j, (F.col("n") - 1).cast("double") * F.lit(float(p))
        picks.append(F.max(F.when(mine, F.col("n"))).alias(f"n_{i}"))
        for tag, r in (("0", F.floor(pos)), ("1", F.ceil(pos))):
            picks.append(F.max(F.when(mine & (F.col("start") <= r) & (F.col("end") >= r), F.col("value")))
                         .alias(f"v{tag}_{i}"))
    found = ranks.agg(*picks)
    return found.select(*[F.when(F.col(f"n_{i}").isNotNull(), interpolate(
        F.col(f"n_{i}"), p, F.col(f"v0_{i}"), F.col(f"v1_{i}"))).alias(f"{prefix}{i}") for i, (_, p) in enumerate(specs)])


def exact_percentiles(df: DataFrame, col: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """1-row DataFrame with columns ``{prefix}0..{prefix}k-1``: exact
    linear-interpolation percentiles of ``col``; null when it has no values."""
    return exact_percentiles_multi(df, [(col, p) for p in probs], prefix)


def exact_percentiles_multi(df: DataFrame, specs: list[tuple[str, float]], prefix: str = "q") -> DataFrame:
    """``exact_percentiles`` for several ``(column, probability)`` in one scan."""
    cols = list(dict.fromkeys(c for c, _ in specs))
    return percentiles_of(value_ranks(df, cols), [(cols.index(c), p) for c, p in specs], prefix)


# ---------------------------------------------------------------------------
# approximate percentiles
# ---------------------------------------------------------------------------

#: Rank error of a KLL sketch of size k: about RANK_ERROR / k ** 0.9 of all values, at 99 % confidence.
RANK_ERROR = 2.296
MIN_K, MAX_K = 8, 65535


def sketch_size(accuracy: float) -> int:
    """Smallest sketch whose ranks are off by ``accuracy`` (a share of all values) at most, at 99 % confidence."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy is a share of all values, between 0 and 1")
    k = math.ceil((RANK_ERROR / accuracy) ** (1 / 0.9021))
    if k > MAX_K:
        raise ValueError(f"a sketch of {MAX_K} is the largest: accuracy from {RANK_ERROR / MAX_K ** 0.9021:.1e} on")
    return max(MIN_K, k)


def value_sketches(df: DataFrame, cols: list[str], accuracy: float, by: list[str] | None = None) -> DataFrame:
    """(by, sketch_<col>...): mergeable quantile sketches of the columns, without nulls and NaN, in one
    scan; a task sends one sketch per group, of a size that does not depend on the rows."""
    k = sketch_size(accuracy)
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    return df.groupBy(*(by or [])).agg(*[F.kll_sketch_agg_double(v, k).alias(f"sketch_{c}") for v, c in zip(values, cols)])


def merged_sketches(sketches: DataFrame, cols: list[str], accuracy: float, by: list[str] | None = None) -> DataFrame:
    """The same by fewer keys, from the sketches alone."""
    k = sketch_size(accuracy)
    return sketches.groupBy(*(by or [])).agg(*[F.kll_merge_agg_double(f"sketch_{c}", k).alias(f"sketch_{c}") for c in cols])


def sketched_quantile(sketch: Column, p: float | Column) -> Column:
    """A value whose rank is near ``p``; null of an empty sketch."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, p))


def approx_percentiles(df: DataFrame, specs: list[tuple[str, float]], accuracy: float, prefix: str = "q") -> DataFrame:
    """``exact_percentiles_multi`` from sketches: values of the table whose ranks are off by ``accuracy`` at most."""
    cols = list(dict.fromkeys(c for c, _ in specs))
    return value_sketches(df, cols, accuracy).select(*[sketched_quantile(F.col(f"sketch_{c}"), p).alias(f"{prefix}{i}")
                                                       for i, (c, p) in enumerate(specs)])


# ---------------------------------------------------------------------------
# global row numbers and quantile scores
# ---------------------------------------------------------------------------

def global_row_number(df: DataFrame, order_cols: list[str], name: str = "rn") -> DataFrame:
    """``row_number() over (order by order_cols)`` without an unbounded
    single-partition window: rows are numbered inside ranges of ``order_cols``
    and shifted by the row counts of the ranges before.

    ``order_cols`` must identify a row uniquely (add a key as tie-breaker).
    """
    ranged = range_numbered(df, order_cols, "row_number")
    local = ranged.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per range: bounded by the partition count, safe to broadcast
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_lrn"))
            .drop("_pid", "_lrn", "_off"))


def score_by_edges(x: Column, edges: list[Column], reverse: bool = False) -> Column:
    """Quartile-style score: 1 + number of edges strictly below ``x``
    (right-closed bins, lowest included). ``reverse`` gives ``len(edges)+1 - that``."""
    above = F.lit(0)
    for e in edges:
        above = above + F.when(x > e, 1).otherwise(0)
    return F.lit(len(edges) + 1) - above if reverse else above + F.lit(1)


def rank_quartile_score(rn: Column, n: Column, q: int = 4) -> Column:
    """qcut(rank, q) for ranks 1..n: edges at 1 + j(n-1)/q, right-closed."""
    s = F.lit(1)
    for j in range(1, q):
        s = s + F.when(rn.cast("double") > F.lit(1.0) + (n - 1).cast("double") * F.lit(j / q), 1).otherwise(0)
    return s


# ---------------------------------------------------------------------------
# windows on short ordered series
# ---------------------------------------------------------------------------

def centered_moving_average(df: DataFrame, value: str, order: str, window: int = 12,
                            min_periods: int | None = None, name: str = "trend") -> DataFrame:
    """Centred rolling mean (pandas ``rolling(window, center=True)``): rows
    ``[-(window//2), (window-1)//2]``, null with fewer than ``min_periods`` values.

    The mean is taken over exact decimals, so it is order-independent.
    Intended for short series (months): the window has no partition key.
    """
    min_periods = window // 2 if min_periods is None else min_periods
    w = Window.orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
    from ledgerlens.functions.exprs import exact
    s = F.sum(exact(value)).over(w).cast("double")
    c = F.count(F.col(value)).over(w)
    return df.withColumn(name, F.when(c >= min_periods, s / c.cast("double")))


# ---------------------------------------------------------------------------
# histogram
# ---------------------------------------------------------------------------

def equal_width_bins(x: Column, lo: Column, hi: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """Bin index 0..bins-1 as numpy.histogram assigns it: edges ``lo + i*step``,
    left-closed, the last bin closed on both sides. ``lo == hi`` widens the
    range to ``[lo - 0.5, hi + 0.5]`` first, as numpy does."""
    lo2 = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    step = (hi2 - lo2) / F.lit(float(bins))
    norm = F.lit(float(bins)) / (hi2 - lo2)
    i0 = F.least(F.floor((x - lo2) * norm), F.lit(bins - 1))

    def edge(i):
        return F.when(i >= bins, hi2).otherwise(i.cast("double") * step + lo2)

    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((i1 != bins - 1) & (x >= edge(i1 + 1)), i1 + 1).otherwise(i1)
    return i2.cast("int")


def bin_edges(lo: Column, hi: Column, i: Column, bins: int = HISTOGRAM_BINS) -> tuple[Column, Column]:
    lo2 = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    step = (hi2 - lo2) / F.lit(float(bins))
    lower = i.cast("double") * step + lo2
    upper = F.when(i + 1 >= bins, hi2).otherwise((i + 1).cast("double") * step + lo2)
    return lower, upper
