from conftest import rows
from pyspark.sql import functions as F

from cellweave.functions.regions import STUDY_BOXES, box_table, expand_regions, region_class
from cellweave.operators.slices import map_slice

POINTS = [(-118.0, 33.0), (-115.0, 37.5), (-130.0, 40.0), (-150.0, 20.0), (-160.0, 5.0)]


def points(spark):
    return spark.createDataFrame(POINTS, "lon double, lat double")


def test_class_is_the_first_box(spark):
    found = points(spark).select("lon", region_class("lat", "lon").alias("r"))
    assert rows(found, "lon") == [
        (-160.0, None), (-150.0, "NE Pacific"), (-130.0, "CCS"), (-118.0, "Local"),
        (-115.0, "Local"),
    ]


def test_membership_is_every_box(spark):
    found = expand_regions(points(spark), whole="Domain").groupBy("region").count()
    assert rows(found, "region") == [("CCS", 3), ("Domain", 5), ("Local", 2), ("NE Pacific", 4)]


def test_membership_equals_a_range_join(spark):
    df = spark.range(2000).select(
        (F.rand(1) * 80 - 165).alias("lon"), (F.rand(2) * 65).alias("lat"), F.col("id")
    )
    boxes = box_table(spark)
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(
        F.col("lon_min"), F.col("lon_max")
    )
    joined = df.join(F.broadcast(boxes), inside).select("id", "region")
    expanded = expand_regions(df).select("id", "region")
    assert joined.exceptAll(expanded).count() == 0
    assert expanded.exceptAll(joined).count() == 0


def test_class_is_a_member(spark):
    df = points(spark).withColumn("class", region_class("lat", "lon"))
    members = expand_regions(df).filter("class = region")
    assert members.count() == df.filter("class IS NOT NULL").count()


def test_open_box(spark):
    box = STUDY_BOXES[0]
    assert points(spark).filter(box.holds("lat", "lon", closed=False)).count() == 1


def test_map_slice(spark):
    df = spark.createDataFrame(
        [("a", 1, 33.0, -118.0, 1500.0), ("a", 1, 40.0, -118.0, 0.0), ("a", 2, 33.0, -118.0, 5.0),
         ("a", 1, 5.0, -160.0, 7.0), ("b", 1, 33.0, -118.0, 9.0), ("a", 1, 35.0, -118.0, -2.0)],
        "phase string, month int, lat double, lon double, v double",
    )
    found = map_slice(df, "v", "a", 1, STUDY_BOXES[1], cap=1000, blank_zero=True,
                      blank_negative=True, divide_by=10)
    assert rows(found, "lat") == [(33.0, -118.0, 100.0), (35.0, -118.0, None), (40.0, -118.0, None)]
    assert rows(map_slice(df, "v", "a", 1, valid=(0, 10)).filter("fill IS NOT NULL"), "lat") == [
        (5.0, -160.0, 7.0), (40.0, -118.0, 0.0),
    ]
