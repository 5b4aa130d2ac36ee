"""Tables laid out for maps: Morton order, so that a box of the map is few row groups.

Rows are sorted by time and, within it, along the Z-curve of their position. Each row
group then covers one time and a small rectangle, its minimum and maximum of latitude,
longitude and time say so, and a filter on them skips the other row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per axis: 2**12 steps over 360 degrees, finer than any native cell row.
BITS = 12


def morton(lat: str = "lat", lon: str = "lon", bits: int = BITS) -> Column:
    """Place on the Z-curve; positions beyond the globe's frame count as its edge."""
    steps = 1 << bits
    place = F.lit(0).cast("long")
    for name, low, width in ((lon, -180.0, 360.0), (lat, -90.0, 180.0)):
        step = F.floor((F.col(name) - low) / width * steps).cast("long")
        step = F.greatest(F.least(step, F.lit(steps - 1)), F.lit(0))
        shift = 0 if name == lon else 1
        for bit in range(bits):
            one = F.shiftright(step, bit).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(one, 2 * bit + shift))
    return place


def write_map(
    df: DataFrame,
    path: str,
    leading: Sequence[str] = ("phase", "time"),
    lat: str = "lat",
    lon: str = "lon",
    group_bytes: int = 32 << 20,
    mode: str = "errorifexists",
) -> None:
    """Write ``df`` sorted by ``leading`` and Morton order, in row groups of about this size.

    Rows are dealt by ranges of that order: a time with very many cells takes several
    files, and a range never spans the globe. The order is kept as the column ``morton``.
    """
    placed = df.withColumn("morton", morton(lat, lon))
    dealt = placed.repartitionByRange(*leading, "morton").sortWithinPartitions(*leading, "morton")
    dealt.write.mode(mode).option("parquet.block.size", str(group_bytes)).parquet(path)
