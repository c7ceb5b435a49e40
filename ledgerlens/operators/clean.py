"""Cleaning: header names, types, missing values, duplicates, quality rules.

Steps run in this order (``clean_sales``): standardize names, fix types,
handle missing values, remove duplicates, fix quality issues, engineer
features. The order is part of the semantics: the segment mode is taken
before any row is dropped, and de-duplication runs before categories are
re-cased, so copies that differ only in casing survive it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.constants import MONTH_NAMES
from ledgerlens.functions.exprs import finite_or_null, half_up, safe_div, title_case, whole_number
from ledgerlens.operators import fingerprint

SALES_COLUMNS = ["order_id", "customer_id", "segment", "date", "product", "category",
                 "region", "city", "quantity", "unit_price", "discount", "revenue", "profit"]
NUMERIC_COLUMNS = ["unit_price", "revenue", "profit", "discount"]
REQUIRED_COLUMNS = ["revenue", "unit_price", "quantity", "date"]


def normalize_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def standardize_columns(df: DataFrame) -> DataFrame:
    """Trim, lower-case and join whitespace runs with ``_`` in every column name.

    Two names that normalise to the same string are an error (pandas would
    silently keep both and break later lookups).
    """
    new = [normalize_name(c) for c in df.columns]
    seen = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both normalise to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def parsed_date(df: DataFrame, date_format: str = "yyyy-MM-dd") -> Column:
    """The ``date`` column as a date: date and timestamp columns as they are,
    text by ``date_format`` (null where it does not fit)."""
    kind = df.schema["date"].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col("date").cast("date")
    return F.try_to_timestamp(F.col("date").cast("string"), F.lit(date_format)).cast("date")


def fix_dtypes(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Coerce types; anything unparsable becomes null.

    * date: date and timestamp columns, or text in ``date_format``
    * unit_price, revenue, profit, discount: double, NaN and infinities -> null
    * quantity: whole numbers only (fractions -> null), bigint
    """
    cols = {"date": parsed_date(df, date_format),
            "quantity": whole_number(F.col("quantity").cast("string"))}
    cols.update({c: finite_or_null(F.col(c).try_cast("double")) for c in NUMERIC_COLUMNS})
    return df.withColumns(cols)


def parse_failures(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """(column_name, failures): per typed column, how many given values
    ``fix_dtypes`` could not read (a wrong ``date_format`` shows here)."""
    df = standardize_columns(raw)
    names = ["date", "quantity", *NUMERIC_COLUMNS]
    before = df.select("*", *[F.col(c).isNotNull().alias(f"_had_{c}") for c in names])
    lost = fix_dtypes(before, date_format).agg(
        *[F.count_if(F.col(f"_had_{c}") & F.col(c).isNull()).alias(c) for c in names])
    return lost.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures"))
                                           for c in names])).alias("r")).select("r.*")


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """1-row DataFrame: most frequent non-null value, ties -> smallest value.

    A grouped count (partially aggregated per task, so a hot value is cheap)
    followed by a top-1; no data passes through the driver.
    """
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
            .orderBy(F.col("count").desc(), F.col(column).asc()).limit(1)
            .select(F.col(column).alias("mode")))


def handle_missing(df: DataFrame) -> DataFrame:
    """discount -> 0, city -> 'Unknown', segment -> its mode; then drop rows
    with a null revenue, unit_price, quantity or date."""
    seg_mode = mode_value(df, "segment").scalar()
    return (df.withColumns({"discount": F.coalesce(F.col("discount"), F.lit(0.0)),
                            "city": F.coalesce(F.col("city"), F.lit("Unknown")),
                            "segment": F.coalesce(F.col("segment"), seg_mode)})
            .dropna(subset=REQUIRED_COLUMNS))


def remove_duplicates(df: DataFrame, by: str = "rows") -> DataFrame:
    """Full-row de-duplication. ``by="rows"``: one pass, in which all rows are shuffled (after a partial
    de-duplication per task). ``by="fingerprint"``: ``df`` is read three times, but only fingerprints and rows that
    have copies are shuffled; for wide rows in files."""
    if by == "fingerprint":
        return fingerprint.distinct_rows(df)
    if by != "rows":
        raise ValueError(f"duplicates are found by rows or by fingerprint, not by {by!r}")
    return df.dropDuplicates()


def fix_quality_issues(df: DataFrame) -> DataFrame:
    """Keep quantity > 0, title-case category, recompute revenue (2 dp)."""
    return (df.where(F.col("quantity") > 0)
            .withColumns({"category": title_case("category"),
                          "revenue": half_up(F.col("unit_price") * F.col("quantity")
                                             * (F.lit(1.0) - F.col("discount")), 2)}))


def engineer_features(df: DataFrame) -> DataFrame:
    """year, month, month_name, quarter, year_month, profit_margin (4 dp)."""
    # month name and 'YYYY-MM' from the month/year numbers: same text as a
    # date formatter, without one
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    year, month = F.year("date"), F.month("date")
    return df.withColumns({
        "year": year, "month": month,
        "month_name": F.element_at(names, month),
        "quarter": F.quarter("date"),
        "year_month": F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
                               F.lpad(month.cast("string"), 2, "0")),
        "profit_margin": half_up(safe_div("profit", "revenue"), 4)})


def clean_sales(raw: DataFrame, dedup_after: bool = False,
                audit: dict | None = None, date_format: str = "yyyy-MM-dd", by: str = "rows") -> DataFrame:
    """The seven cleaning steps in the reference order.

    ``by`` as in ``remove_duplicates``; by fingerprint, which reads ``raw`` three times, there is no ``audit``.

    ``date_format`` is the layout of a text ``date`` column; ``parse_failures``
    counts what does not fit. ``dedup_after=True`` moves de-duplication after the quality fixes, which
    also removes copies that differed only in casing. Pass a dict as ``audit``
    to get ``Observation`` objects whose metrics (row counts per step) fill in
    when the result is first computed, without extra passes over the data.
    """
    if audit is not None and by != "rows":
        raise ValueError("rows are observed in a single pass only: by='rows'")
    df = fix_dtypes(standardize_columns(raw), date_format)
    df = _observe(df, audit, "typed")
    df = _observe(handle_missing(df), audit, "after_missing")
    if dedup_after:
        df = _observe(fix_quality_issues(df), audit, "after_quality")
        df = _observe(remove_duplicates(df, by), audit, "after_dedup")
    else:
        df = _observe(remove_duplicates(df, by), audit, "after_dedup")
        df = _observe(fix_quality_issues(df), audit, "after_quality")
    return engineer_features(df)


def _observe(df: DataFrame, audit: dict | None, name: str) -> DataFrame:
    if audit is None:
        return df
    obs = Observation(name)
    audit[name] = obs
    return df.observe(obs, F.count(F.lit(1)).alias("rows"))


def _kept_by_null_rule() -> Column:
    keep = F.lit(True)
    for c in REQUIRED_COLUMNS:
        keep = keep & F.col(c).isNotNull()
    return keep


def _audit_by_rows(typed: DataFrame) -> DataFrame:
    """One grouped aggregation over all columns plus a "kept by the null rule" flag: the input rows are the sum of
    the group counts, the survivors of the null rule the sum over kept groups, the de-duplicated rows the number of
    kept groups, and the survivors of the quantity rule the kept groups with quantity > 0."""
    seg_mode = mode_value(typed, "segment").scalar()
    filled = typed.withColumns({"discount": F.coalesce(F.col("discount"), F.lit(0.0)),
                                "city": F.coalesce(F.col("city"), F.lit("Unknown")),
                                "segment": F.coalesce(F.col("segment"), seg_mode)})
    groups = (filled.withColumn("_keep", _kept_by_null_rule()).groupBy(*filled.columns, "_keep")
              .agg(F.count(F.lit(1)).alias("_n")))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(F.col("_keep"), F.col("_n"))), F.lit(0)).alias("kept"),
        F.count_if(F.col("_keep")).alias("dedup"),
        F.count_if(F.col("_keep") & (F.col("quantity") > 0)).alias("quality"))


def _audit_by_fingerprint(typed: DataFrame) -> DataFrame:
    """Rows are counted without a shuffle before and after the null rule; copies are counted by fingerprint, whole
    rows meet only where one repeats. A copy has its original's quantity, so the quantity rule needs the copies
    among the rows that it keeps only."""
    positive, keep = F.col("quantity") > 0, _kept_by_null_rule()
    dropped, dropped_positive = fingerprint.copies(handle_missing(typed), flag=positive)
    return typed.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(keep).alias("kept"),
                     F.count_if(keep & positive).alias("positive")).select(
        "raw_rows", "kept", (F.col("kept") - dropped).alias("dedup"), (F.col("positive") - dropped_positive).alias("quality"))


def cleaning_audit(raw: DataFrame, date_format: str = "yyyy-MM-dd", loading: DataFrame | None = None,
                   by: str = "rows") -> DataFrame:
    """Rows before/after/dropped for each row-removing step, as a table; with
    ``loading`` (``sources.load.load_audit``) the steps of reading the files come first.
    ``by`` as in ``remove_duplicates``: one pass that shuffles rows, or three that shuffle fingerprints.
    """
    typed = fix_dtypes(standardize_columns(raw), date_format)
    if by not in ("rows", "fingerprint"):
        raise ValueError(f"duplicates are found by rows or by fingerprint, not by {by!r}")
    counts = _audit_by_rows(typed) if by == "rows" else _audit_by_fingerprint(typed)

    def step(no, name, before, after):
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"),
                        F.col(before).alias("rows_before"), F.col(after).alias("rows_after"))

    steps = counts.select(F.explode(F.array(
        step(1, "handle_missing", "raw_rows", "kept"),
        step(2, "remove_duplicates", "kept", "dedup"),
        step(3, "fix_quality_issues", "dedup", "quality"))).alias("s")).select("s.*")
    steps = steps.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
    return steps if loading is None else loading.unionByName(steps).orderBy("step_no")


def data_quality_report(df: DataFrame) -> DataFrame:
    """Long table (metric, column_name, num_value, str_value): rows, columns,
    date range, nulls per column (only columns with nulls), duplicate rows,
    revenue range. One aggregation pass, and a count of copies by fingerprint."""
    cols = df.columns
    duplicates, _ = fingerprint.copies(df)
    aggs = [F.count(F.lit(1)).alias("rows"), F.min("date").alias("dmin"), F.max("date").alias("dmax"),
            F.min("revenue").alias("rmin"), F.max("revenue").alias("rmax")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(cols)]
    a = df.agg(*aggs)

    def row(metric, column, num, text):
        return F.struct(F.lit(metric).alias("metric"), F.lit(column).cast("string").alias("column_name"),
                        num.cast("double").alias("num_value"), text.cast("string").alias("str_value"))

    items = [row("rows", None, F.col("rows"), F.lit(None)),
             row("columns", None, F.lit(len(cols)), F.lit(None)),
             row("date_min", "date", F.lit(None), F.col("dmin").cast("string")),
             row("date_max", "date", F.lit(None), F.col("dmax").cast("string")),
             row("duplicates", None, duplicates, F.lit(None)),
             row("revenue_min", "revenue", F.col("rmin"), F.lit(None)),
             row("revenue_max", "revenue", F.col("rmax"), F.lit(None))]
    items += [row("nulls", c, F.col(f"n_{i}"), F.lit(None)) for i, c in enumerate(cols)]
    return (a.select(F.explode(F.array(*items)).alias("r")).select("r.*")
            .where((F.col("metric") != "nulls") | (F.col("num_value") > 0)))


def filter_sales(df: DataFrame, years=None, regions=None, categories=None) -> DataFrame:
    """Rows whose year, region and category are all in the given lists.

    ``None`` means no restriction; an empty list selects no rows.
    """
    cond = F.lit(True)
    for col, values in (("year", years), ("region", regions), ("category", categories)):
        if values is None:
            continue
        cond = cond & (F.col(col).isin(list(values)) if len(values) else F.lit(False))
    return df.where(cond)


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct values offered by the three filters, long form (option, value),
    in the dashboard's order: years, regions, categories, each ascending. One scan."""
    pairs = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(name).alias("option"),
                               F.col(name).cast("string").alias("value"))
                      for i, name in enumerate(("year", "region", "category"))])
    return (df.select(F.explode(pairs).alias("o")).select("o.*").where(F.col("value").isNotNull())
            .distinct().orderBy("no", "value").select("option", "value"))
