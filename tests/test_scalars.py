import datetime as dt
import math

import pytest
from conftest import one
from pyspark.sql import functions as F

from cellweave.functions import calendar, physics


@pytest.mark.parametrize(
    "depth, full, top",
    [
        (0.0, 2.5, 2.5),
        (40.0, 5.0, 5.0),
        (80.0, 7.5, 7.5),
        (90.0, 10.0, 10.0),
        (100.0, 15.0, 5.0),
        (85.0, 20.0, 10.0),
        (200.0, 20.0, 5.0),
        (300.0, 10.0, 5.0),
        (None, None, None),
    ],
)
def test_thickness(spark, depth, full, top):
    d = F.lit(depth).cast("double")
    assert one(spark, physics.thickness_full(d)) == full
    assert one(spark, physics.thickness_top100(d)) == top


def test_calendar(spark):
    assert one(spark, calendar.year_month(F.lit("1998-06-16 12:00:00"))) == "1998-06"
    assert one(spark, calendar.year_month(F.lit("no date"))) is None
    moment = calendar.from_seconds_1979(F.lit(613976700))
    assert one(spark, F.date_format(moment, "yyyy-MM-dd HH:mm:ss")) == "1998-06-16 05:05:00"
    day = F.lit(dt.date(1998, 6, 16))
    assert one(spark, calendar.mid_month(day)) == dt.date(1998, 6, 15)
    assert one(spark, calendar.month_start(day)) == dt.date(1998, 6, 1)
    assert one(spark, calendar.month_of_year(day)) == 6
    assert one(spark, calendar.month_label(day)) == "1998-06"
    shifted = calendar.seconds_1979_from_year_one(F.lit(62_419_593_600))
    assert one(spark, shifted) == 0
    parsed = calendar.parse_datetime(F.lit("1998-06-16 05:05:00"))
    assert one(spark, parsed) == dt.datetime(1998, 6, 16, 5, 5)


@pytest.mark.parametrize("label, seconds", [("1998-06", 2592000), ("2000-02", 2505600)])
def test_month_seconds(spark, label, seconds):
    assert one(spark, calendar.month_seconds(calendar.month_date(F.lit(label)))) == seconds


def test_monthly_uptake(spark):
    seconds = calendar.month_seconds(calendar.month_date(F.lit("1998-06")))
    assert one(
        spark, physics.monthly_uptake(F.lit(0.0001), F.lit(1000.0), seconds)
    ) == pytest.approx(259.2)


def test_units(spark):
    there_and_back = physics.to_mmol_per_m3(physics.to_mol_per_kg(F.lit(2000.0)))
    assert one(spark, there_and_back) == pytest.approx(2000.0)
    assert one(spark, physics.to_mol_per_kg(F.lit(1025.18))) == pytest.approx(1e-3)
    assert one(spark, physics.pressure_bar(F.lit(-300.0))) == 30.0
    assert one(spark, physics.moles(F.lit(10.0), F.lit(2500.0))) == 25.0
    assert one(spark, physics.wrap_longitude(F.lit(242.0))) == -118.0
    assert one(spark, physics.wrap_longitude(F.lit(118.0))) == 118.0


def test_depth_class(spark):
    assert one(spark, physics.depth_class(F.lit(90.0))) == "Surface"
    assert one(spark, physics.depth_class(F.lit(100.0))) == "Subsurface"
    assert one(spark, physics.depth_class_rank(F.lit(100.0))) == 2


def test_area_adds_up_to_the_ellipsoid(spark):
    """Bands of 0.125 degrees sum to the surface of the WGS-84 ellipsoid."""
    bands = spark.range(1440).select(
        physics.cell_area(F.col("id") * 0.125 - 90.0 + 0.0625).alias("a")
    )
    total = bands.agg(F.sum("a")).first()[0] * 2880
    e = math.sqrt(0.00669437999014)
    a = 6378137.0
    exact = 2 * math.pi * a * a * (1 + (1 - e * e) / e * math.atanh(e))
    assert total == pytest.approx(exact, rel=1e-6)
