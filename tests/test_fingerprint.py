"""Copies of rows by fingerprint, with hashes short enough to collide."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean, fingerprint
from ledgerlens.plans import queries as Q

SF = "/root/testdata/sf0.001"
ROWS = [("a", None, 0.0, 1), (None, "a", 0.0, 1), ("a", None, -0.0, 1), ("a", None, float("nan"), 1),
        ("a", None, float("nan"), 1), ("a", None, None, 1), (None, None, None, None), (None, None, None, None), ("b", "c", 1.5, -2)]


def key(rows):
    return sorted(str(tuple(0.0 if x == 0 else x for x in r)) for r in rows)


@pytest.mark.parametrize("bits", [0, 1, 3, 128])
def test_same_rows_as_by_whole_rows(spark, bits):
    odd = spark.createDataFrame(ROWS, "x string, y string, z double, q int")
    dirty = clean.handle_missing(clean.fix_dtypes(Q.raw(spark, SF)))
    for df in (odd, odd.limit(0), odd.unionByName(odd), dirty.limit(300).unionByName(dirty.limit(200))):
        want = df.dropDuplicates()
        assert key(fingerprint.distinct_rows(df, bits).collect()) == key(want.collect())
        flag = F.col(df.columns[-1] if "quantity" not in df.columns else "quantity") > 0
        every, flagged = fingerprint.copies(df, bits, flag)
        got = df.sparkSession.range(1).select(every.alias("a"), flagged.alias("b")).first()
        assert tuple(got) == (df.count() - want.count(), df.where(flag).count() - want.where(flag).count())


def test_rows_without_a_copy_are_not_shuffled(spark):
    df = Q.clean_table(spark, SF)
    plan = fingerprint.distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any("_fp1" in x for x in exchanges) and "LeftAnti" in plan
    wide = [x for x in exchanges if "product" in x]
    assert len(wide) == 1                                        # of the rows that have copies
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_one_row_a_third_of_all(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("x"), F.lit("p").alias("y"))
    assert fingerprint.distinct_rows(df).count() == 2001
    with pytest.raises(ValueError, match="fingerprint"):
        clean.remove_duplicates(df, by="hash")


@pytest.mark.parametrize("size", [1, 8, 1 << 15, 1 << 17, fingerprint.MAP_BITS])
def test_rows_whose_bits_collide(spark, size):
    """Many repeated fingerprints in maps of a few bits, of several blocks, and of full size."""
    df = spark.range(4000).select((F.col("id") % 3100).alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    want = df.dropDuplicates()
    got = fingerprint.distinct_rows(df, size=size)
    assert sorted(got.collect()) == sorted(want.collect())
    n, flagged = fingerprint.copies(df, flag=F.col("x") < 100, size=size)
    assert tuple(spark.range(1).select(n, flagged).first()) == (4000 - want.count(), 100)


def test_many_repeated_fingerprints_shuffle_no_other_row(spark):
    """Nothing but the map of bits is broadcast or decided by size: more repeated rows than a broadcast may have."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        df = Q.clean_table(spark, SF)
        plan = fingerprint.distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
        counted = spark.range(1).select(fingerprint.copies(df)[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (plan, counted):
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_audit_shuffles_only_rows_that_have_copies(spark):
    """The registered audit: whole rows are shuffled only above the join with the map of bits that marks them."""
    out = Q.REGISTRY["cleaning_audit"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "order_id" in x]
    assert "_fp1" in plan and len(wide) == plan.count("LeftSemi") > 0        # a subquery may be shown for each use
    assert out.collect() == clean.cleaning_audit(Q.raw(spark, SF), by="rows").collect()
