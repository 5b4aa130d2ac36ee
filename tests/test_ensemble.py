import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cellweave.operators import ensemble, series
from cellweave.operators.scenario import with_differences


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [
            ("lanina", 1, 55.0), ("neutral", 1, 45.0), ("elnino", 1, 50.0),
            ("lanina", 2, 50.0), ("neutral", 2, 60.0), ("elnino", 2, 40.0),
        ],
        "phase string, month int, value double",
    )


def test_mean_envelope_and_deviation(runs):
    found = ensemble.group_means(runs, ["month"], {"mean": "value"})
    found = ensemble.group_envelope(found, ["month"], ["value"])
    found = with_differences(found, {"d": ("value", "mean")})
    picked = found.select("month", "phase", "mean", "min_value", "max_value", "d")
    assert rows(picked, "month", "phase") == [
        (1, "elnino", 50.0, 45.0, 55.0, 0.0),
        (1, "lanina", 50.0, 45.0, 55.0, 5.0),
        (1, "neutral", 50.0, 45.0, 55.0, -5.0),
        (2, "elnino", 50.0, 40.0, 60.0, -10.0),
        (2, "lanina", 50.0, 40.0, 60.0, 0.0),
        (2, "neutral", 50.0, 40.0, 60.0, 10.0),
    ]
    sums = found.groupBy("month").agg(F.sum("d").alias("s"))
    assert rows(sums, "month") == [(1, 0.0), (2, 0.0)]


def test_envelope_is_missing_if_a_run_is(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "p string, month int, x double")
    found = ensemble.group_envelope(df, ["month"], ["x"]).select("p", "min_x", "max_x")
    assert rows(found, "p") == [("a", None, None), ("b", None, None)]


def test_running_sum(runs):
    found = ensemble.running_sum(runs, ["phase"], "month", "value", "cum")
    assert rows(found.select("phase", "month", "cum"), "phase", "month") == [
        ("elnino", 1, 50.0), ("elnino", 2, 90.0), ("lanina", 1, 55.0),
        ("lanina", 2, 105.0), ("neutral", 1, 45.0), ("neutral", 2, 105.0),
    ]


def test_closing_step(runs):
    found = ensemble.repeat_last_period(runs, ["phase"], "month")
    assert found.count() == 9
    last = found.filter("month = 3").select("phase", "value")
    assert rows(last, "phase") == [("elnino", 40.0), ("lanina", 50.0), ("neutral", 60.0)]


def test_running_mean(spark):
    df = spark.range(1, 15).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    found = df.withColumn("g", F.lit(1)).withColumn("m", ensemble.running_mean("x", ["g"], "i"))
    means = [r["m"] for r in found.orderBy("i").collect()]
    assert means == [6.5, 7.5, 8.5] + [None] * 11


def test_running_mean_counts_rows_not_calendar_months(spark):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 15) for i in range(14) if i != 5]
    df = spark.createDataFrame([("r", d, float(i)) for i, d in enumerate(months)],
                               "region string, yr_mon date, x double")
    found = series.running_means(df, ["region"], ["x"])
    filled = found.filter("value IS NOT NULL").orderBy("yr_mon").collect()
    assert [r["value"] for r in filled] == [5.5, 6.5]


def test_block_means(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, 2.0), (3, 6.0), (4, 10.0)], "month int, x double"
    ).withColumn("cell", F.lit(1))
    found = ensemble.block_means(df, ["cell"], "month", {"m": "x"})
    assert rows(found.select("month", "period", "m"), "month") == [
        (1, 1, 3.0), (2, 1, 3.0), (3, 1, 3.0), (4, 2, 10.0),
    ]


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (100.0,)], "depth double")
    assert rows(ensemble.bin_edges(df), "depth") == [
        (0.0, 0.0, 2.5), (5.0, 2.5, 7.5), (10.0, 7.5, 55.0), (100.0, 55.0, 100.0),
    ]


def test_first_periods_rank_distinct_times(spark):
    df = spark.createDataFrame(
        [("a", "2000-03"), ("a", "2000-01"), ("a", "2000-01"), ("b", "2000-03")],
        "phase string, time string",
    )
    found = ensemble.first_periods(df, 1)
    assert rows(found.select("phase", "time", "month"), "phase", "time") == [
        ("a", "2000-01", 1), ("a", "2000-01", 1), ("b", "2000-03", 1),
    ]


def monthly(spark, data):
    return spark.createDataFrame(
        [(r, dt.date(y, m, 15), v) for r, y, m, v in data],
        "region string, yr_mon date, x double",
    )


def test_climatology_and_anomaly(spark):
    df = monthly(spark, [
        ("r", 2000, 1, 1.0), ("r", 2001, 1, 3.0), ("r", 2000, 2, 5.0), ("r", 2001, 2, None),
    ])
    clim = series.climatology(df, ["region"], "x", "clim")
    assert rows(clim, "moy") == [("r", 1, 2.0), ("r", 2, None)]
    anom = series.anomalies(df, ["region"], "x", "clim", "anom").select("yr_mon", "anom")
    assert [r["anom"] for r in anom.orderBy("yr_mon").collect()] == [-1.0, None, 1.0, None]


def test_correlation_modes(spark):
    data = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)]
    df = spark.createDataFrame(data, "a double, b double")
    assert df.agg(series.correlation("a", "b")).first()[0] == pytest.approx(0.9979487157886733)
    holed = spark.createDataFrame([*data, (4.0, None)], "a double, b double")
    assert holed.agg(series.correlation("a", "b", "strict")).first()[0] is None
    assert holed.agg(series.correlation("a", "b")).first()[0] == pytest.approx(0.9979487157886733)


def test_reference_pairs_drop_missing(spark):
    df = monthly(spark, [
        ("ref", 2000, 1, 1.0), ("ref", 2000, 2, 2.0), ("r", 2000, 1, 5.0), ("r", 2000, 3, 6.0),
        ("r", 2000, 2, None),
    ])
    reference = series.reference_series(df, "ref", "x")
    pairs = series.against_reference(df.filter("region = 'r'"), reference, "x")
    assert [(r["x"], r["reference"]) for r in pairs.collect()] == [(5.0, 1.0)]


def test_reshape_and_slices(spark):
    df = monthly(spark, [("a", 2000, 1, 1.0), ("b", 2000, 1, 2.0), ("a", 2000, 2, None)])
    wide = series.widen(df, ["yr_mon"], "region", "x", ["a", "b"])
    assert [(r["a"], r["b"]) for r in wide.orderBy("yr_mon").collect()] == [(1.0, 2.0), (None, None)]
    long = series.lengthen(wide, ["yr_mon"], ["a", "b"])
    assert long.count() == 4
    assert series.before(df, "2000-02-15").count() == 2
    assert series.earliest(df, "yr_mon").count() == 2
    assert series.earliest(df, "yr_mon", ["region"]).count() == 2
    kept = series.quality_rule(df, "a", F.col("x") >= 2)
    assert rows(kept.select("region", "x"), "region") == [("b", 2.0)]
