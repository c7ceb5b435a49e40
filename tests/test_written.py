"""What is shuffled for written tables and headline totals."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.operators import clean, cube, eda
from ledgerlens.plans import queries as Q
from ledgerlens.plans.materialize import materialized
from ledgerlens.sources import files
from ledgerlens.sources.load import load_sales


def hints_of(kind, action):
    """The hints given to DataFrames of that class while ``action`` ran."""
    seen, real = [], kind.hint

    def hint(self, name, *a):
        seen.append(name)
        return real(self, name, *a)

    kind.hint = hint
    try:
        action()
    finally:
        kind.hint = real
    return seen


def test_write_clean_shuffles_rows_only_when_asked(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=3).select(F.col("id"), (F.col("id") % 4).cast("int").alias("year"))
    for rebalance in (False, True):
        path = str(tmp_path / str(rebalance))
        hints = hints_of(type(df), lambda: files.write_clean(df, path, rebalance=rebalance))
        assert hints == ["rebalance"] * rebalance
        assert sorted(spark.read.parquet(path).collect()) == sorted(df.collect())
        assert len(glob.glob(path + "/year=*/*.zstd.parquet")) == (4 if rebalance else 12)


def test_clean_rows_by_fingerprint_equal_those_by_rows(spark):
    raw = Q.raw(spark, "/root/testdata/sf0.001")
    want, got = clean.clean_sales(raw), clean.clean_sales(raw, by="fingerprint")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_customers_are_counted_by_their_ids_alone(spark):
    rows = [("c1", "A", "X"), ("c1", "B", "X"), (None, "A", None), ("c2", None, "Y"), ("c3", "A", "Y")]
    df = spark.createDataFrame(rows, "customer_id string, category string, region string").withColumns(
        {"revenue": F.lit(1.5), "profit": F.lit(0.5), "profit_margin": F.lit(0.25)})
    out = eda.summary_stats(df)
    assert tuple(out.first()) == (7.5, 2.5, 5, 3, 1.5, 0.25, "A", "X")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("customer_id" in x for x in plan.splitlines() if "FileScan" in x and "gid" in x)


def test_loaded_rows_are_written_with_zstd(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    load = load_sales(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert sorted(load.rows.collect(), key=str) == [("1", "2"), ("3", None)]
    assert len(glob.glob(str(tmp_path / "out/fate=*/*.zstd.parquet"))) == 3


@pytest.fixture
def small_shares(spark, monkeypatch):
    """A shuffle partition for every 4 KB of input; none are joined afterwards."""
    monkeypatch.setattr(session, "PARTITION_BYTES", 4 << 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_written_tables_have_shuffles_for_the_size_of_their_input(spark, tmp_path, small_shares):
    src = str(tmp_path / "a table=1%")
    spark.range(0, 20000, numPartitions=3).write.parquet(src)
    size = sum(os.path.getsize(f) for f in glob.glob(src + "/*.parquet"))
    out = materialized(spark, "sized-test", src, lambda s, d: s.read.parquet(d).groupBy("id").count())
    assert len(out.inputFiles()) == -(-size // (4 << 10)) > 3 * int(small_shares)
    assert out.where("count = 1").count() == 20000
    assert spark.conf.get("spark.sql.shuffle.partitions") == small_shares


def test_sized_shuffles_give_the_setting_back(spark, small_shares):
    name = "spark.sql.shuffle.partitions"
    with session.sized_shuffles(spark.createDataFrame([(1,)], "a int")):
        assert spark.conf.get(name) == small_shares                     # no files, and never fewer than set
    with pytest.raises(KeyError), session.sized_shuffles(Q.sales(spark, "/root/testdata/sf0.001")):
        assert int(spark.conf.get(name)) > int(small_shares)
        raise KeyError
    assert spark.conf.get(name) == small_shares


def test_cube_is_built_in_shares_of_the_sales(spark, small_shares):
    s = Q.sales(spark, "/root/testdata/sf0.001")
    built = cube.build_cube(s)
    assert all(len(t.inputFiles()) > 3 * int(small_shares) for t in built)
    want = s.groupBy("segment").agg(F.count_distinct("customer_id"))
    assert sorted(cube.distinct_customers(built.customers, "segment").collect()) == sorted(want.collect())
    assert built.customers.groupBy(*cube.CUSTOMER_KEYS, "bucket").count().where("count > 1").isEmpty()
