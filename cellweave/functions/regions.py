"""Latitude/longitude boxes.

The three study boxes nest, so *membership* (a cell counts in every box that
holds it) and *class* (the first box that holds it) differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column


@dataclass(frozen=True)
class Box:
    region: str
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float

    def holds(self, lat: ColumnLike, lon: ColumnLike, closed: bool = True) -> Column:
        y, x = as_column(lat), as_column(lon)
        if closed:
            return y.between(self.lat_min, self.lat_max) & x.between(self.lon_min, self.lon_max)
        return (
            (y > self.lat_min) & (y < self.lat_max) & (x > self.lon_min) & (x < self.lon_max)
        )


# The study boxes, innermost first.
STUDY_BOXES = (
    Box("Local", -127.0, -115.0, 27.5, 37.5),
    Box("CCS", -140.0, -110.0, 22.5, 47.5),
    Box("NE Pacific", -155.0, -95.0, 10.0, 60.0),
)


def box_table(spark: SparkSession, boxes=STUDY_BOXES) -> DataFrame:
    """The boxes as a dimension table."""
    return spark.createDataFrame(
        [(b.region, b.lon_min, b.lon_max, b.lat_min, b.lat_max) for b in boxes],
        "region string, lon_min double, lon_max double, lat_min double, lat_max double",
    )


def region_class(lat: ColumnLike, lon: ColumnLike, boxes=STUDY_BOXES) -> Column:
    """Name of the first box that holds the point, else NULL."""
    name = F.lit(None).cast("string")
    for box in reversed(boxes):
        name = F.when(box.holds(lat, lon), box.region).otherwise(name)
    return name


def expand_regions(
    df: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    boxes=STUDY_BOXES,
    whole: str | None = None,
    out: str = "region",
) -> DataFrame:
    """One row per (row, box that holds it); ``whole`` adds a label that holds every row.

    A generator over the literal box list replaces a range join: the rows stay
    in their partition and the next ``groupBy`` combines them before it shuffles.
    """
    labels = [F.when(box.holds(lat, lon), F.lit(box.region)) for box in boxes]
    if whole is not None:
        labels.append(F.lit(whole))
    return df.withColumn(out, F.explode(F.array(*labels))).filter(F.col(out).isNotNull())
