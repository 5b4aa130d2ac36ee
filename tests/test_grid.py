"""Hand-computed scenario, integral and subduction cases."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cellweave.functions.missing import strict
from cellweave.functions.physics import thickness_full
from cellweave.operators import ensemble, integrate, scenario

KEYS = ["lon", "lat", "depth", "time"]


@pytest.fixture(scope="module")
def treated(spark):
    return spark.createDataFrame(
        [
            (-118.0, 33.0, 0.0, "1998-06", 2010.0, 1805.0),
            (-118.0, 33.0, 5.0, "1998-06", 2004.0, 1802.0),
            (-118.0, 33.0, 90.0, "1998-06", 2001.0, 1800.5),
            (-130.0, 40.0, 0.0, "1998-06", 2000.0, 1800.0),
            (-118.0, 33.0, 0.0, "1998-07", 2020.0, 1812.0),
            (-130.0, 40.0, 0.0, "1998-07", 2000.0, 1800.0),
        ],
        "lon double, lat double, depth double, time string, alk double, dic double",
    ).withColumn("phase", F.lit("lanina"))


@pytest.fixture(scope="module")
def control(treated):
    return (
        treated.filter("NOT (lon = -130 AND time = '1998-06')")
        .select(*KEYS)
        .withColumns({"alk_con": F.lit(2000.0), "dic_con": F.lit(1800.0)})
    )


@pytest.fixture(scope="module")
def moles(treated, control):
    paired = scenario.pair_with_control(
        treated, control, KEYS, {"dta": ("alk", "alk_con"), "ddic": ("dic", "dic_con")}
    )
    volume = thickness_full("depth") * 1000.0
    return integrate.cell_moles(paired, {"dta_mol": "dta", "ddic_mol": "ddic"}, volume)


def test_cells(moles):
    found = rows(
        integrate.with_efficiency(moles).select("time", "lon", "depth", "dta_mol", "cdr_eff"),
        "time",
        "lon",
        "depth",
    )
    assert found == [
        ("1998-06", -130.0, 0.0, None, None),
        ("1998-06", -118.0, 0.0, 25.0, 0.5),
        ("1998-06", -118.0, 5.0, 20.0, 0.5),
        ("1998-06", -118.0, 90.0, 10.0, 0.5),
        ("1998-07", -130.0, 0.0, 0.0, None),
        ("1998-07", -118.0, 0.0, 50.0, 0.6),
    ]


def test_integral_and_strict_sum(moles):
    numbered = ensemble.number_rows(integrate.integrate(moles, ["phase", "time"]), ["phase"], "time")
    assert rows(numbered.select("time", "month", "dta_sum", "ddic_sum", "cdr_eff"), "time") == [
        ("1998-06", 1, 55.0, 27.5, 0.5),
        ("1998-07", 2, 50.0, 30.0, 0.6),
    ]
    whole = moles.groupBy("time").agg(strict(F.sum("dta_mol"), "dta_mol").alias("s"))
    assert rows(whole, "time") == [("1998-06", None), ("1998-07", 50.0)]


def test_subducted_under_current_and_maximum_depth(spark, moles):
    hbls = spark.createDataFrame(
        [(-118.0, 33.0, "1998-06", 1, 50.0), (-118.0, 33.0, "1998-07", 2, 3.0)],
        "lon double, lat double, time string, month int, hbls double",
    )
    current = integrate.subducted(
        moles.join(hbls.drop("month"), ["lon", "lat", "time"], "left"), ["time"], {"dta": "dta_mol"}
    )
    assert rows(current, "time") == [("1998-06", 55.0, 10.0, 10 / 55), ("1998-07", 50.0, 0.0, 0.0)]
    deepest = integrate.row_of_maximum(hbls, ["lon", "lat"], "hbls", "month")
    under = integrate.subducted(
        moles.join(deepest.drop("month"), ["lon", "lat"], "left"), ["time"], {"dta": "dta_mol"}
    )
    assert rows(under, "time") == [("1998-06", 55.0, 10.0, 10 / 55), ("1998-07", 50.0, 0.0, 0.0)]


def test_column_integral(treated, control):
    paired = scenario.pair_with_control(
        treated, control, KEYS, {"dta": ("alk", "alk_con"), "ddic": ("dic", "dic_con")}
    )
    found = integrate.column_integral(paired, ["lon", "lat", "time"])
    assert rows(found, "time", "lon") == [
        (-130.0, 40.0, "1998-06", 0.0, 0.0, None, None),
        (-118.0, 33.0, "1998-06", 55.0, 27.5, 0.5, 0.5),
        (-130.0, 40.0, "1998-07", 0.0, 0.0, None, None),
        (-118.0, 33.0, "1998-07", 50.0, 30.0, 0.6, 0.6),
    ]


def test_layers_add_up_to_the_domain(moles):
    layers = integrate.integrate(moles, ["phase", "depth", "time"])
    assert rows(layers.groupBy("time").agg(F.sum("dta_sum")), "time") == [
        ("1998-06", 55.0),
        ("1998-07", 50.0),
    ]


def test_runs_of_one_table_pair_like_separate_tables(spark):
    raw = spark.createDataFrame(
        [
            ("A", 1, 2.0), ("A", 1, 4.0), ("A", 2, 5.0), ("N", 1, None), ("N", 3, 7.0),
            ("control", 1, 1.0), ("control", 3, None), ("control", 4, 9.0),
        ],
        "run string, cell int, x double",
    )
    single = scenario.pair_runs(raw, ["cell"], "run", ["A", "N"], "control", {"x": "x"})
    means = raw.groupBy("run", "cell").agg(F.avg("x").alias("x"))
    treated = means.filter("run <> 'control'").withColumnRenamed("run", "phase")
    control = means.filter("run = 'control'").select("cell", F.col("x").alias("x_con"))
    joined = scenario.pair_with_control(treated, control, ["cell"], {"d": ("x", "x_con")})
    order = ["phase", "cell"]
    assert rows(single.select("phase", "cell", "x", "x_con"), *order) == rows(
        joined.select("phase", "cell", "x", "x_con"), *order
    )


def test_stacking_and_merging(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, x double")
    b = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, x double, y double")
    stacked = scenario.stack_runs({"a": a, "b": b}).select("phase", "k", "x", "y")
    assert rows(stacked, "phase", "k") == [
        ("a", 1, 1.0, None), ("b", 1, 2.0, 3.0), ("b", 2, 4.0, 5.0),
    ]
    assert scenario.append_rows(a, a).count() == 2
    merged = scenario.merge_runs(a, b.withColumnRenamed("x", "z"), ["k"])
    assert rows(merged, "k") == [(1, 1.0, 2.0, 3.0), (2, None, 4.0, 5.0)]
    assert scenario.drop_land(merged, ["x"]).count() == 1


def test_missing_share(spark):
    whole = spark.createDataFrame([("t", 10.0), ("u", 0.0)], "time string, s double")
    part = spark.createDataFrame([("t", 8.0), ("u", 1.0)], "time string, s double")
    found = scenario.missing_share(whole, part, ["time"], "s")
    assert rows(found.select("time", "difference", "share_missing"), "time") == [
        ("t", 2.0, 0.2), ("u", -1.0, None),
    ]


def test_share_outside_equals_two_grids(spark):
    cells = spark.createDataFrame(
        [("t", 1, 8.0), ("t", 2, 2.0), ("u", 2, 5.0), ("v", 1, None), ("v", 2, 1.0)],
        "time string, cell int, x double",
    )
    inside = F.col("cell") == 1
    sums = {"s": "x"}
    two = scenario.missing_share(
        integrate.totals(cells, ["time"], sums),
        integrate.totals(cells.filter(inside), ["time"], sums),
        ["time"],
        "s",
    )
    single = scenario.share_outside(cells, ["time"], "x", inside, "s")
    assert rows(single, "time") == rows(two, "time") == [
        ("t", 10.0, 8.0, 2.0, 0.2), ("v", 1.0, 0.0, 1.0, 1.0),
    ]
