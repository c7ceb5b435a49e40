"""CSV exports whose lines have too few or too many fields."""

import pytest

from ledgerlens.operators.clean import cleaning_audit
from ledgerlens.plans.report import run_analysis_csv
from ledgerlens.sources.load import FATES, load_audit, load_sales

HEADER = "order_id,customer_id,segment,date,product,category,region,city,quantity,unit_price,discount,Revenue ,Profit"
GOOD = "o{},c{},Corporate,2024-0{}-02,pen,office,East,Paris,2,10,0.1,18,4"


def export(tmp_path, *files):
    folder = tmp_path / "export"
    folder.mkdir()
    for i, lines in enumerate(files):
        (folder / f"{i}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_every_line_has_one_fate(spark, tmp_path):
    path = export(tmp_path, ["x,y,_line", "1,2,3", "", "1,2", "1", "1,2,3,4", '"a,b",c', '"a,b",c,d,e', "1,2,3,"],
                  ["x,y,_line", 'NA,,"q ""z"", y"', '"a ""b, c"" d",5,6,7', '"""x"",y",2,3', " ,5", 'a"b,c"d,e'])
    load = load_sales(spark, path)
    assert load.rows.columns == ["x", "y", "_line"]
    assert sorted(map(str, map(tuple, load.rows.collect()))) == sorted(map(str, [
        ("1", "2", "3"), ("1", "2", None), ("1", None, None), ("a,b", "c", None), (None, None, 'q "z", y'),
        ('"x",y', "2", "3"), (" ", "5", None), ('a"b', 'c"d', "e")]))
    bad = load.bad_rows.collect()
    assert sorted((r.fields, r.line) for r in bad) == [
        (4, '"a ""b, c"" d",5,6,7'), (4, '"a,b",c,d,e'), (4, "1,2,3,"), (4, "1,2,3,4")]
    assert {r.expected for r in bad} == {3} and all("/export/" in r.file for r in bad)
    assert [tuple(r) for r in load.counts.collect()] == [("whole", 4), ("short", 4), ("surplus", 4), ("unreadable", 0)]
    assert [tuple(r) for r in load_audit(load).collect()] == [(-1, "load_sales", 12, 8, 4), (0, "fill_short_rows", 4, 4, 0)]


def test_line_breaks_in_quotes_and_headers_in_another_order(spark, tmp_path):
    path = export(tmp_path, ["x,y", '"two', 'lines",2', '"two', 'lines",2,3'])
    load = load_sales(spark, path, multi_line=True)
    assert [tuple(r) for r in load.rows.collect()] == [("two\nlines", "2")]
    assert [(r.fields, r.line) for r in load.bad_rows.collect()] == [(3, '"two\nlines",2,3')]
    (tmp_path / "export" / "1.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_sales(spark, path)


def test_empty_export(spark, tmp_path):
    load = load_sales(spark, export(tmp_path, ["x,y"]))
    assert load.rows.collect() == [] and load.bad_rows.collect() == []
    assert [tuple(r) for r in load.counts.collect()] == [(f, 0) for f in FATES]


def test_rows_are_read_from_the_written_table(spark, tmp_path):
    load = load_sales(spark, export(tmp_path, ["x,y,z", "1,2,3", "1,2"]))
    plan = load.rows.select("y")._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower() and "ReadSchema: struct<row:struct<y:string>>" in plan
    assert "PartitionFilters" in plan and "whole" in plan


def test_analysis_of_an_export(spark, tmp_path):
    lines = [HEADER, *[GOOD.format(i, i % 3, 1 + i % 9) for i in range(30)], GOOD.format(90, 1, 1) + ",stray",
             "o91,c1,Corporate,2024-01-02,pen", GOOD.format(92, 1, 1).replace("2024-01-02", "02.01.2024")]
    paths = run_analysis_csv(spark, export(tmp_path, lines), str(tmp_path / "out"))
    audit = [tuple(r) for r in spark.read.parquet(paths["loading_audit"]).orderBy("step_no").collect()]
    assert audit == [(-1, "load_sales", 33, 32, 1), (0, "fill_short_rows", 1, 1, 0), (1, "handle_missing", 32, 30, 2),
                     (2, "remove_duplicates", 30, 30, 0), (3, "fix_quality_issues", 30, 30, 0)]
    failures = {r.column_name: r.failures for r in spark.read.parquet(paths["parse_failures"]).collect()}
    assert failures["date"] == 1 and sum(failures.values()) == 1
    assert spark.read.parquet(paths["bad_rows"]).count() == 1
    assert spark.read.parquet(paths["summary_stats"]).first().total_orders == 30


def test_audit_without_loading_is_unchanged(spark, tmp_path):
    load = load_sales(spark, export(tmp_path, [HEADER, GOOD.format(1, 1, 1), GOOD.format(1, 1, 1)]))
    assert [r.step_no for r in cleaning_audit(load.rows).collect()] == [1, 2, 3]
