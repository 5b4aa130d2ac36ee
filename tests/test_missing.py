import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cellweave.functions import missing as m
from cellweave.operators.integrate import row_of_maximum, totals, weighted_mean


def values(spark, data):
    return spark.createDataFrame(data, "g string, x double, w double")


def test_nan_becomes_null(spark):
    df = values(spark, [("a", float("nan"), 1.0), ("a", 2.0, None)])
    assert rows(m.clean_measures(df), "x") == [("a", None, 1.0), ("a", 2.0, None)]


def test_sum_of_nothing_is_zero_and_mean_is_missing(spark):
    df = values(spark, [("a", None, 1.0), ("b", 2.0, 1.0)])
    found = df.groupBy("g").agg(m.sum0("x").alias("s"), F.avg("x").alias("m"))
    assert rows(found, "g") == [("a", 0.0, None), ("b", 2.0, 2.0)]


def test_total_over_no_rows_is_one_zero_row(spark):
    empty = values(spark, []).filter("g = 'none'")
    assert rows(totals(empty, [], {"s": "x"}), "s") == [(0.0,)]


def test_strict_aggregate(spark):
    df = values(spark, [("a", 1.0, 1.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0)])
    found = df.groupBy("g").agg(
        m.strict(F.avg("x"), "x").alias("mean"), m.strict(F.max("x"), "x").alias("max")
    )
    assert rows(found, "g") == [("a", None, None), ("b", 2.0, 3.0)]


@pytest.mark.parametrize("n, d, expected", [(1.0, 0.0, None), (0.0, 0.0, None), (3.0, 2.0, 1.5)])
def test_ratio(spark, n, d, expected):
    assert one(spark, m.ratio(F.lit(n), F.lit(d))) == expected


@pytest.mark.parametrize(
    "n, d, expected", [(-1.0, 2.0, None), (1.0, 0.0, None), (0.0, 2.0, 0.0), (1.0, 2.0, 0.5)]
)
def test_ratio_if_positive(spark, n, d, expected):
    assert one(spark, m.ratio_if_positive(F.lit(n), F.lit(d))) == expected


@pytest.mark.parametrize("x, expected", [(1500.0, 1000.0), (20.0, 20.0), (None, None)])
def test_cap_keeps_missing(spark, x, expected):
    assert one(spark, m.cap(F.lit(x).cast("double"), 1000)) == expected


def test_masks(spark):
    assert one(spark, m.zero_to_null(F.lit(0.0))) is None
    assert one(spark, m.keep_nonnegative(F.lit(-1.0))) is None
    assert one(spark, m.keep_nonnegative(F.lit(0.0))) == 0.0
    assert one(spark, m.keep_between(F.lit(1.5), 0, 1)) is None
    assert one(spark, m.log10_positive(F.lit(-1.0))) is None
    assert one(spark, m.log10_positive(F.lit(100.0))) == 2.0


def test_text_that_is_no_number(spark):
    assert one(spark, m.to_number(F.lit("abc"))) is None
    assert one(spark, m.to_number(F.lit("33.5"))) == 33.5


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(2.0, 1.0), (4.0, 3.0)], 3.5),
        ([(2.0, 1.0), (4.0, 3.0), (None, 1.0)], None),
        ([(2.0, 0.0), (4.0, 0.0)], None),
    ],
)
def test_weighted_mean(spark, pairs, expected):
    df = values(spark, [("a", x, w) for x, w in pairs])
    assert df.agg(weighted_mean("x", "w").alias("v")).first()["v"] == expected


def test_row_of_maximum_takes_the_first_of_equals(spark):
    data = [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0), ("a", 4, None), ("b", 1, None)]
    df = spark.createDataFrame(data, "cell string, month int, hbls double")
    assert rows(row_of_maximum(df, ["cell"], "hbls", "month"), "cell") == [("a", 9.0, 2)]
