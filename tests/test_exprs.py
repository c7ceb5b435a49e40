"""Shared numeric and text helpers at their borders."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import finite_or_null, half_up, title_case


@pytest.mark.parametrize("value,digits,want", [
    (2.5, 0, 3.0), (-2.5, 0, -2.0), (1.005, 2, 1.0), (0.125, 2, 0.13), (2.0e15, 4, 2.0e15), (1.5e13, 6, 1.5e13),
    (1e18, 2, 1e18), (-1e18, 2, -1e18), (1e300, 6, 1e300), (float("inf"), 2, float("inf")), (None, 2, None)])
def test_half_up(spark, value, digits, want):
    assert spark.createDataFrame([(value,)], "x double").select(half_up("x", digits)).first()[0] == want


def test_half_up_keeps_nan_and_takes_whole_numbers(spark):
    assert math.isnan(spark.sql("select double('nan') x").select(half_up("x")).first()[0])
    assert spark.sql("select 9223372036854775807L x").select(half_up("x")).first()[0] == float(2 ** 63)


def test_finite_or_null(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, float("inf"), -float("inf"), float("nan"), None)], "x double")
    assert [r[0] for r in df.select(finite_or_null("x")).collect()] == [1.0, None, None, None, None]


@pytest.mark.parametrize("text,want", [
    ("office-supplies o'neil", "Office-Supplies O'Neil"), ("TECHNOLOGY", "Technology"), ("a1b c2D", "A1B C2D"),
    ("élan vital", "Élan Vital"), ("", ""), ("  two  ", "  Two  "), (None, None)])
def test_title_case(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(title_case(F.col("x"))).first()[0] == want


def test_title_case_is_the_same_with_and_without_other_characters(spark):
    texts = ["", " ", "promo BRUSHED steel", "  two  blanks ", "é ß ÄRZTE ǆ", "o'neil", "a1b2c", "tab\there", "line\n", "line\nnext", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(title_case("x")).collect()]
    runs = F.regexp_extract_all("x", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    assert got == [r[0] for r in df.select(F.array_join(F.transform(runs, F.initcap), "")).collect()]
    assert got[2:6] == ["Promo Brushed Steel", "  Two  Blanks ", "É Ss Ärzte ǅ", "O'Neil"]
