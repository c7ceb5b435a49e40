"""Column-expression helpers shared by all operators.

All helpers return ``Column`` expressions so they stay inside whole-stage
codegen; none of them is a Python UDF.

Numeric policy
--------------
* ``half_up(x, n)`` rounds half away from -inf as ``floor(x*10^n + 0.5)/10^n``.
  It gives the same bits in Spark and in an SQL oracle (``round`` does not:
  the engines break ties of computed doubles differently).
  Where a double has no digits left below the ``n``-th decimal (``|x|*10^n``
  of 2^53 or more), and for infinities and NaN, the value is returned as it is.
* Money is summed exactly as ``decimal(38,6)`` and returned as ``double``; the
  result does not depend on partitioning or summation order. Amounts that a
  decimal cannot hold (infinite, NaN, 10^32 or more) count as missing; cleaning
  already turns non-finite input into nulls, where the null rule sees it.
* Division always goes through ``try_divide`` (ANSI mode raises on ``x/0``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.constants import DISCOUNT_TIERS

MONEY = "decimal(38,6)"   # money amounts and their sums, to a millionth
RATIO = "decimal(38,8)"   # profit margins and discounts
EXACT = float(2 ** 53)    # from here on a double is a whole number


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, n: int = 2) -> Column:
    """Round to ``n`` decimals, ties upwards: ``floor(x*10^n + 0.5) / 10^n``."""
    scale = float(10 ** n)
    c = _c(c).cast("double")
    return F.when(F.abs(c) * F.lit(scale) < F.lit(EXACT),
                  F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(c)


def significant(c, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits, ties upwards: the same relative accuracy for amounts of any size."""
    c = _c(c).cast("double")
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    up, down = F.pow(F.lit(10.0), power), F.pow(F.lit(10.0), -power)
    return (F.when(c == 0, c).when(power >= 0, F.floor(c * up + F.lit(0.5)) / up)
            .otherwise(F.floor(c / down + F.lit(0.5)) * down))


def money(c) -> Column:
    """Round a money amount to cents."""
    return half_up(c, 2)


def exact(c, dtype: str = MONEY) -> Column:
    """An amount as a decimal; null where it does not fit."""
    return _c(c).try_cast(dtype)


def money_sum(c) -> Column:
    """Exact sum of an amount as double; all-null sums to 0.0 (pandas rule)."""
    return F.coalesce(F.sum(exact(c)).cast("double"), F.lit(0.0))


def exact_avg(c, dtype: str = MONEY) -> Column:
    """Mean of a column, summed exactly; null when no values."""
    return F.try_divide(F.sum(exact(c, dtype)).cast("double"), F.count(exact(c, dtype)).cast("double"))


def money_avg(c) -> Column:
    return exact_avg(c, MONEY)


def safe_div(a, b) -> Column:
    """``a / b`` with null for ``b = 0`` (pandas gives NaN/inf; we give null)."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))


def finite_or_null(c) -> Column:
    """NaN and infinities -> null after a numeric cast (both parse from text)."""
    c = _c(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def whole_number(c) -> Column:
    """A string parsed as a whole number; fractions, NaN, inf, junk -> null."""
    d = finite_or_null(_c(c).try_cast("double"))
    return F.when((d == F.floor(d)) & (F.abs(d) < F.lit(1e18)), d.cast("bigint"))


def title_case(c) -> Column:
    """Capital at the start of every run of letters, small letters after it
    ("office-supplies o'neil" -> "Office-Supplies O'Neil"). Text of letters and blanks
    only, as most is, needs no splitting."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.when(_c(c).rlike(r"\A[\p{L} ]*\z"), F.initcap(_c(c))).otherwise(F.array_join(F.transform(runs, F.initcap), ""))


def discount_tier(c="discount") -> Column:
    """Tier label for right-closed bins; outside or null -> null."""
    c = _c(c)
    out = None
    for _, label, lo, hi in DISCOUNT_TIERS:
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def discount_tier_order(c="discount") -> Column:
    c = _c(c)
    out = None
    for order, _, lo, hi in DISCOUNT_TIERS:
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(order)) if out is None else out.when(cond, F.lit(order))
    return out


def month_start(year_month) -> Column:
    """'YYYY-MM' -> first day of that month as a date."""
    return F.to_date(F.concat(_c(year_month), F.lit("-01")))
