import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean
from ledgerlens.sources.files import read_sales_csv, write_clean

RAW_COLS = ["order_id", "customer_id", "segment", "date", "product", "category", "region", "city",
            "quantity", "unit_price", "discount", "Revenue ", "Profit"]


def raw_df(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in RAW_COLS))


def test_standardize_columns_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Revenue ` int, `My  Col` int, ` Profit` int")
    assert clean.standardize_columns(df).columns == ["revenue", "my_col", "profit"]
    clash = spark.createDataFrame([(1, 2)], "`A ` int, `a` int")
    with pytest.raises(ValueError):
        clean.standardize_columns(clash)


def test_fix_dtypes_strict(spark):
    rows = [("o1", "c1", "S", d, "p", "CAT", "R", "X", q, "10.0", disc, "1", "0.5")
            for d, q, disc in [("2024-01-05", "3", "0.1"), ("2024-01-05 10:00", "2", "NaN"),
                               ("2024-1-5", "1.5", None), ("not-a-date", "n/a", "0.2"), ("2024-02-29", "4.0", "x")]]
    out = clean.fix_dtypes(clean.standardize_columns(raw_df(spark, rows))).collect()
    assert [str(r.date) if r.date else None for r in out] == ["2024-01-05", None, None, None, "2024-02-29"]
    assert [r.quantity for r in out] == [3, 2, None, None, 4]
    assert [r.discount for r in out] == [0.1, None, None, 0.2, None]


def test_mode_ties_smallest_and_taken_before_drop(spark):
    rows = [("o1", "c", "B", "2024-01-01", "p", "c", "r", "x", "1", "1", "0", "1", "1"),
            ("o2", "c", "A", "2024-01-01", "p", "c", "r", "x", "1", "1", "0", "1", "1"),
            ("o3", "c", "B", "bad", "p", "c", "r", "x", "1", "1", "0", "1", "1"),
            ("o4", "c", "A", "2024-01-01", "p", "c", "r", "x", "1", "1", "0", "1", "1"),
            ("o5", "c", None, "2024-01-01", "p", "c", "r", None, "1", "1", None, "1", "1")]
    typed = clean.fix_dtypes(clean.standardize_columns(raw_df(spark, rows)))
    assert clean.mode_value(typed, "segment").first()["mode"] == "A"
    out = {r.order_id: r for r in clean.handle_missing(typed).collect()}
    assert "o3" not in out
    assert out["o5"].segment == "A" and out["o5"].city == "Unknown" and out["o5"].discount == 0.0


def test_dedup_before_recasing_keeps_late_duplicates(spark):
    base = ["o1", "c", "S", "2024-01-01", "p", "OFFICE SUPPLIES", "r", "x", "2", "10", "0.1", "1", "1"]
    lower = list(base)
    lower[5] = "office supplies"
    df = raw_df(spark, [tuple(base), tuple(base), tuple(lower)])
    out = clean.clean_sales(df).collect()
    assert len(out) == 2 and {r.category for r in out} == {"Office Supplies"}
    assert out[0].revenue == 18.0
    assert len(clean.clean_sales(df, dedup_after=True).collect()) == 1


def test_profit_margin_null_on_zero_revenue(spark):
    rows = [("o1", "c", "S", "2024-03-31", "p", "c", "r", "x", "2", "10", "1", "0", "5"),
            ("o2", "c", "S", "2024-03-31", "p", "c", "r", "x", "-1", "10", "0", "0", "5")]
    out = clean.clean_sales(raw_df(spark, rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert r.revenue == 0.0 and r.profit_margin is None
    assert (r.year, r.month, r.month_name, r.quarter, r.year_month) == (2024, 3, "Mar", 1, "2024-03")


def test_csv_roundtrip_header_and_null_tokens(spark, tmp_path):
    p = os.path.join(str(tmp_path), "raw.csv")
    with open(p, "w") as f:
        f.write(",".join(RAW_COLS) + "\n")
        f.write("o1,c1,NA,2024-01-02,p,cat,r,,n/a,1.5,,3,1\n")
        f.write("o2,c1,Corporate,2024-01-03,p,cat,r,Paris,2,1.5,0.1,3,1\n")
    df = read_sales_csv(spark, p)
    assert df.columns == RAW_COLS
    rows = df.orderBy("order_id").collect()
    assert rows[0]["segment"] is None and rows[0]["city"] is None and rows[0]["quantity"] is None
    out = clean.clean_sales(df).collect()
    assert [r.order_id for r in out] == ["o2"]


def test_filter_sales_empty_list_selects_nothing(spark):
    df = spark.createDataFrame([(2020, "East", "Tech")], "year int, region string, category string")
    assert clean.filter_sales(df, [], None, None).count() == 0
    assert clean.filter_sales(df, [2020], ["East"], ["Tech"]).count() == 1
    assert clean.filter_sales(df).count() == 1


def test_write_clean_csv_roundtrip(spark, tmp_path):
    from ledgerlens.sources.files import write_clean
    rows = [("o1", "c1", "S", "2024-01-05", "p", "CAT", "R", "Paris, FR", "3", "10.5", "0.1", "1", "0.5"),
            ("o2", "c2", "S", "2023-12-31", "p", "cat", "R", None, "2", "4", None, "1", "0.5")]
    cleaned = clean.clean_sales(raw_df(spark, rows))
    path = write_clean(cleaned, os.path.join(str(tmp_path), "out"), "csv", "year")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 2
    got = {r.order_id: r for r in back.collect()}
    assert got["o1"]["city"] == "Paris, FR" and got["o2"]["city"] == "Unknown"
    assert sorted(r.year for r in back.select(F.col("year").cast("int").alias("year")).collect()) == [2023, 2024]


def test_clean_sales_observations_match_audit(spark):
    from ledgerlens.plans import queries as Q
    raw = Q.raw(spark, "/root/testdata/sf0.001")
    audit = {}
    out = clean.clean_sales(raw, audit=audit)
    out.write.format("noop").mode("overwrite").save()
    got = {k: v.get["rows"] for k, v in audit.items()}
    steps = {r.step: r for r in clean.cleaning_audit(raw).collect()}
    assert got["typed"] == steps["handle_missing"].rows_before == 6068
    assert got["after_missing"] == steps["handle_missing"].rows_after
    assert got["after_dedup"] == steps["remove_duplicates"].rows_after
    assert got["after_quality"] == steps["fix_quality_issues"].rows_after == 5865


RAW = ("order_id string, customer_id string, segment string, date string, product string, category string, "
       "region string, city string, quantity string, unit_price string, discount string, revenue string, profit string")


def raw_row(**own):
    row = {"order_id": "o", "customer_id": "c", "segment": "S", "date": "2024-05-01", "product": "P", "category": "cat",
           "region": "R", "city": "C", "quantity": "2", "unit_price": "10", "discount": "0", "revenue": "20", "profit": "5"}
    return tuple({**row, **own}.values())


def test_dates_by_type_and_by_layout(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from ledgerlens.operators.clean import clean_sales, cleaning_audit, parse_failures
    raw = spark.createDataFrame([raw_row()], RAW)
    day = dt.date(2024, 5, 1)
    for kind in ("date", "timestamp", "timestamp_ntz"):
        assert [r.date for r in clean_sales(raw.withColumn("date", F.col("date").cast(kind))).collect()] == [day]
    other = raw.withColumn("date", F.lit("05/01/2024"))
    assert [r.date for r in clean_sales(other, date_format="MM/dd/yyyy").collect()] == [day]
    assert clean_sales(other).collect() == []
    assert {r.column_name: r.failures for r in parse_failures(other).collect()}["date"] == 1
    assert {r.column_name: r.failures for r in parse_failures(other, "MM/dd/yyyy").collect()}["date"] == 0
    assert cleaning_audit(other, "MM/dd/yyyy").collect()[0].rows_dropped == 0


def test_infinite_and_huge_prices(spark):
    from ledgerlens.operators import eda
    from ledgerlens.operators.clean import clean_sales, cleaning_audit, parse_failures
    raw = spark.createDataFrame([raw_row(), raw_row(order_id="p", unit_price="inf"), raw_row(order_id="q", profit="NaN"),
                                 raw_row(order_id="r", unit_price="1e17", revenue="2e17")], RAW)
    clean = clean_sales(raw)
    assert {r.order_id: (r.revenue, r.profit) for r in clean.collect()} == {
        "o": (20.0, 5.0), "q": (20.0, None), "r": (2e17, 5.0)}
    assert eda.region_performance(clean).first().revenue == pytest.approx(2e17)
    assert cleaning_audit(raw).collect()[0].rows_dropped == 1
    assert {r.column_name: r.failures for r in parse_failures(raw).collect()} == {
        "date": 0, "quantity": 0, "unit_price": 1, "revenue": 0, "profit": 1, "discount": 0}


def test_category_title_case(spark):
    from ledgerlens.operators.clean import clean_sales
    raw = spark.createDataFrame([raw_row(category="office-supplies o'neil")], RAW)
    assert clean_sales(raw).first().category == "Office-Supplies O'Neil"


def test_csv_dialect(spark, tmp_path):
    def read(text, name="a.csv", **options):
        folder = tmp_path / name
        folder.mkdir()
        for i, t in enumerate(text if isinstance(text, list) else [text]):
            (folder / f"{i}.csv").write_text(t)
        return [tuple(r) for r in read_sales_csv(spark, str(folder), **options).collect()]

    assert read('x,y\n"C ""q"", z",2\n', "quotes") == [('C "q", z', "2")]
    assert read('x,y\n"two\nlines",2\n', "lines", multi_line=True) == [("two\nlines", "2")]
    with pytest.raises(Exception, match="(?i)malformed"):
        read("x,y\n1,2,3\n", "surplus")
    with pytest.raises(Exception, match="(?i)header"):
        read(["x,y\n1,2\n", "y,x\n2,1\n"], "order")


def test_clean_csv_has_all_columns(spark, tmp_path):
    from ledgerlens.operators.clean import clean_sales
    clean = clean_sales(spark.createDataFrame([raw_row()], RAW))
    path = write_clean(clean, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(path).columns == clean.columns


def test_filter_options_are_sorted(spark):
    from ledgerlens.operators.clean import filter_options
    df = spark.createDataFrame([(2024, "W", "b"), (2023, "E", None), (2024, "E", "a")], "year int, region string, category string")
    assert [tuple(r) for r in filter_options(df).collect()] == [
        ("year", "2023"), ("year", "2024"), ("region", "E"), ("region", "W"), ("category", "a"), ("category", "b")]


def test_changed_source_files_are_read_again(spark, tmp_path):
    from ledgerlens.plans.materialize import materialized
    build = lambda s, d: s.read.parquet(f"{d}/t.parquet")
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert materialized(spark, "t", str(tmp_path), build).count() == 3
    first = materialized(spark, "t", str(tmp_path), build).inputFiles()
    assert materialized(spark, "t", str(tmp_path), build).inputFiles() == first
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert materialized(spark, "t", str(tmp_path), build).count() == 5
