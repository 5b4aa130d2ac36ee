"""Points in boxes, where the boxes are rows of a table.

A range join compares every point with every box. Here both are put into square bins, and
points meet boxes by equality of bins: a box lies in the bins of the level whose width is
just above its larger side, four at most, and a point in one bin of each level that any
box uses. What meets is then compared exactly. Levels double in width, so there are as
many as the logarithm of the largest box over the smallest.

Where only the number and mean of each box's points are wanted, no pair is made, as each
point may lie in any share of the boxes. Points are dealt into slabs of bounded size by
longitude, and again by latitude. A box ends in two slabs of each kind at most, where it
meets their points in a task; slabs between are whole, and what lies in whole slabs of both
kinds is a table of sums by pairs of slabs, which is again points in boxes, fewer of them.
So the work grows with points and boxes (times the logarithm of a slab), wherever they lie.
A task adds values up as whole numbers, so that differences of running totals lose nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cellweave.sources.shared import shared_root
from cellweave.sources.tables import stage

BOUNDS = ("lon_min", "lon_max", "lat_min", "lat_max")
#: Width of the bins of level 0, in degrees; smaller boxes use it as well.
FINEST = 1.0 / 64.0
#: Level at which one bin is wider than the globe.
TOP = 15
#: Points of a slab, about, and boxes that meet them in one task.
SLAB, MEETING = 200_000, 100_000


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(FINEST) * F.pow(F.lit(2.0), level))).cast("int")


def binned_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` once for each bin that it reaches into: at most four."""
    side = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))
    level = F.greatest(F.ceil(F.log2(side / FINEST)), F.lit(0))
    leveled = boxes.filter(
        (F.col("lon_min") <= F.col("lon_max")) & (F.col("lat_min") <= F.col("lat_max"))
    ).withColumn("_level", F.least(F.when(side > 0, level).otherwise(0), F.lit(TOP)).cast("int"))
    spread = {}
    for axis in ("lon", "lat"):
        low, high = (_bin(F.col(f"{axis}_{end}"), F.col("_level")) for end in ("min", "max"))
        spread[axis] = F.explode(F.sequence(low, high))
    return leveled.withColumn("_lon_bin", spread["lon"]).withColumn("_lat_bin", spread["lat"])


def join_boxes(
    points: DataFrame,
    boxes: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    closed: bool = True,
    by: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Each point with each box (``lon_min, lon_max, lat_min, lat_max`` and further columns)
    that holds it. Points or boxes with a missing coordinate, and boxes whose bounds are
    the wrong way round, join nothing.

    With ``by``, a column of the boxes, and ``value``, a column of the points: what grouping
    these pairs gives, without making them. ``by``, the number of pairs as ``points`` and
    their mean as ``value_mean``; missing values count as points and have no part in the mean."""
    if by is not None:
        return _box_means(points, boxes, lat, lon, closed, by, value)
    tiles = binned_boxes(boxes)
    levels = tiles.agg(F.sort_array(F.collect_set("_level")).alias("l")).scalar()
    placed = (
        points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .withColumn("_level", F.explode(levels))
        .withColumn("_lon_bin", _bin(F.col(lon), F.col("_level")))
        .withColumn("_lat_bin", _bin(F.col(lat), F.col("_level")))
    )
    met = placed.join(tiles, ["_level", "_lon_bin", "_lat_bin"])
    x, y = F.col(lon), F.col(lat)
    if closed:
        inside = x.between(F.col("lon_min"), F.col("lon_max")) & y.between(F.col("lat_min"), F.col("lat_max"))
    else:
        inside = (x > F.col("lon_min")) & (x < F.col("lon_max")) & (y > F.col("lat_min")) & (y < F.col("lat_max"))
    return met.filter(inside).drop("_level", "_lon_bin", "_lat_bin")


#: What is added up: points, values that are not missing, and these values.
SUMS = {"points": LongType(), "values": LongType(), "total": DoubleType()}
#: Bits of a limb: in a task values are whole numbers of so many bits each.
LIMB = 31
#: The slabs of both axes: their numbers and least values.
STARTS = [f"{a}_{what}" for a in ("x", "y") for what in ("slabs", "least")]


def _box_means(
    points: DataFrame, boxes: DataFrame, lat: str, lon: str, closed: bool, by: str, value: str
) -> DataFrame:
    """Number and mean of the points of each box, by the boxes' column ``by``."""
    x, y, v = (F.col(c).cast("double") for c in (lon, lat, value))
    placed = points.select(x.alias("x"), y.alias("y"), v.alias("v")).filter(_known("x", "y"))
    # equal positions are one point, so that slabs can be cut between any two
    at = placed.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("points"), F.count("v").alias("values"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")
    )
    inside = F.col("x0") <= F.col("x1") if closed else F.col("x0") < F.col("x1")
    inside &= F.col("y0") <= F.col("y1") if closed else F.col("y0") < F.col("y1")
    bounds = [F.col(c).cast("double").alias(n) for c, n in zip(BOUNDS, ("x0", "x1", "y0", "y1"), strict=True)]
    asked = boxes.select(F.col(by).alias("_by"), *bounds).filter(_known("x0", "x1", "y0", "y1") & inside)
    asked = asked.withColumn("_n", F.monotonically_increasing_id()).withColumn("slab", F.lit(0))
    asked = stage(asked, "boxes", shared_root(boxes.sparkSession))
    parts = _sums_in_boxes(at.withColumn("slab", F.lit(0)), asked, (closed, closed))
    sums = parts.groupBy("_by").agg(*[F.sum(c).alias(c) for c in SUMS])
    mean = F.when(F.col("values") > 0, F.col("total") / F.col("values"))
    return sums.select(F.col("_by").alias(by), "points", mean.alias(f"{value}_mean"))


def _known(*names: str) -> Column:
    """None of these columns is missing."""
    return reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in names])


def _sums_in_boxes(points: DataFrame, boxes: DataFrame, closed: tuple[bool, bool]) -> DataFrame:
    """``_by`` and parts of the ``SUMS`` of each box (``_by``, ``_n``, x0, x1, y0, y1; a staged table)
    over the points (x, y, ``SUMS``) in it, no two of one position. Both have a column ``slab``
    of 0; ``closed`` tells whether the bounds of x, and of y, belong to a box."""
    root, seen = shared_root(points.sparkSession), Observation()
    points = stage(points.observe(seen, F.count(F.lit(1)).alias("points")), "points", root)
    count = seen.get["points"]
    if count <= SLAB:
        return _meet(points, boxes, closed)
    # pairs of slabs are at most half as many as points
    slabs = min(-(-count // SLAB), max(2, math.isqrt(count // 2)))
    for axis, order in (("x", ("x", "y")), ("y", ("y", "x"))):
        dealt = points.repartitionByRange(slabs, *order).withColumn(f"{axis}_slab", F.spark_partition_id())
        points = stage(dealt, f"{axis}_slabs", root)
    ended = stage(_ended(points, boxes, closed), "ends", root)
    # a box has whole slabs between its first and its last
    across = _between(ended, "x")
    numbered = points.withColumn("x", F.col("x_slab").cast("double"))
    cells = numbered.groupBy("slab", "x", F.col("y_slab").cast("double").alias("y"))
    inner = stage(_between(across, "y").select(*boxes.columns), "boxes", root)
    return (
        _meet(_slab(points, "x"), _end_slabs(ended, "x"), closed)
        .unionByName(_meet(_slab(numbered, "y"), _end_slabs(across, "y"), (True, closed[1])))
        .unionByName(_sums_in_boxes(cells.agg(*[F.sum(c).alias(c) for c in SUMS]), inner, (True, True)))
    )


def _slab(points: DataFrame, axis: str) -> DataFrame:
    return points.withColumn("slab", F.col(f"{axis}_slab"))


def _end_slabs(boxes: DataFrame, axis: str) -> DataFrame:
    """Each box in the slabs in which it begins and ends, which may be one."""
    return boxes.withColumn("slab", F.explode(F.array_distinct(F.array(f"{axis}_first", f"{axis}_last"))))


def _between(boxes: DataFrame, axis: str) -> DataFrame:
    """Boxes that hold whole slabs of an axis, with the numbers of these slabs as bounds."""
    first, last = F.col(f"{axis}_first") + 1, F.col(f"{axis}_last") - 1
    held = boxes.filter(first <= last)
    return held.withColumns({f"{axis}0": first.cast("double"), f"{axis}1": last.cast("double")})


def _ended(points: DataFrame, boxes: DataFrame, closed: tuple[bool, bool]) -> DataFrame:
    """``boxes`` with the slabs of each axis in which they begin and end: those after the first
    hold no value below the box, those before the last none above it."""
    named = boxes.withColumn("_task", F.floor(F.col("_n") / MEETING))
    # each task gets the least values of all slabs
    tasks = named.select("_task").distinct()
    for axis in ("x", "y"):
        least = points.groupBy(f"{axis}_slab").agg(F.min(axis).alias("least"))
        held = F.sort_array(F.collect_list(F.struct(f"{axis}_slab", "least")))
        tasks = tasks.withColumn(axis, least.agg(held).scalar())
        tasks = tasks.withColumns({f"{axis}_slabs": F.col(f"{axis}.{axis}_slab"), f"{axis}_least": F.col(f"{axis}.least")})
    ends = [StructField(f"{a}_{end}", IntegerType()) for a in ("x", "y") for end in ("first", "last")]

    def run(there: pa.Table, slabs: pa.Table) -> pa.Table:
        there = there.drop_columns(["_task"])
        for axis, shut in zip(("x", "y"), closed, strict=True):
            numbers, least = (np.array(slabs[f"{axis}_{what}"][0].as_py()) for what in ("slabs", "least"))
            for end, bound, below in (("first", "0", shut), ("last", "1", not shut)):
                at = np.searchsorted(least[1:], there[f"{axis}{bound}"].to_numpy(), "left" if below else "right")
                there = there.append_column(f"{axis}_{end}", pa.array(numbers[at], pa.int32()))
        return there

    grouped = tasks.select("_task", *STARTS).groupBy("_task")
    return named.groupBy("_task").cogroup(grouped).applyInArrow(run, StructType([*boxes.schema.fields, *ends]))


def _meet(points: DataFrame, boxes: DataFrame, closed: tuple[bool, bool]) -> DataFrame:
    """``_by`` and the ``SUMS`` of each box over the points of its slab that lie in it.

    The boxes of a slab are dealt to tasks of about ``MEETING``, which have all its points.
    """
    tasks = boxes.groupBy("slab").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("_tasks"))
    asked = boxes.join(tasks, "slab").withColumn("_task", F.pmod(F.xxhash64("_n"), F.col("_tasks")).cast("int"))
    held = points.join(tasks, "slab").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    held = held.select("slab", "_task", "x", "y", *SUMS).groupBy("slab", "_task")
    asked = asked.select("slab", "_task", "_by", "x0", "x1", "y0", "y1").groupBy("slab", "_task")
    schema = StructType([boxes.schema["_by"], *[StructField(c, kind) for c, kind in SUMS.items()]])

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        x, y, *added = (here[c].to_numpy() for c in ("x", "y", *SUMS))
        bounds = [there[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]
        high, limbs = in_limbs(added[2])
        found = sums_in_boxes(x, y, np.column_stack([*added[:2], limbs]), *bounds, closed)
        total = of_limbs(high, found[:, 2:])
        table = pa.table([there["_by"], *map(pa.array, (found[:, 0], found[:, 1], total))], names=["_by", *SUMS])
        return table.filter(pa.array(found[:, 0] > 0))

    return held.cogroup(asked).applyInArrow(run, schema)


def in_limbs(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Whole numbers whose sums lose nothing: NaN, infinity, -infinity (1 where a value is one), and
    the limbs of finite values. The first limb has the bits below 2 ** (the number returned)."""
    finite = np.where(np.isfinite(values), values, 0.0)
    sizes = np.abs(finite[finite != 0])
    high, low = (np.frexp(v)[1] for v in (sizes.max(initial=0.0), sizes.min(initial=math.inf) if len(sizes) else 0.0))
    rest = max(low - 53, -1074)
    limbs = [
        np.ldexp(np.fmod(finite, np.ldexp(1.0, top)) if top < high else finite, LIMB - top)
        for top in range(high, rest, -LIMB)
    ]
    return int(high), np.column_stack([np.isnan(values), values == math.inf, values == -math.inf, *limbs]).astype(np.int64)


def of_limbs(high: int, sums: np.ndarray) -> np.ndarray:
    """The sums of values from those of ``in_limbs``."""
    nan, up, down, *limbs = sums.T
    carry, held = np.zeros(len(sums), np.int64), []
    # what a limb holds beyond its bits goes to the one above, so that no two cancel out
    for limb in reversed(limbs):
        limb = limb + carry
        carry = limb >> LIMB
        held.append(limb & ((1 << LIMB) - 1))
    total = np.ldexp(carry.astype(float), high)
    for k, limb in enumerate(reversed(held), 1):
        total += np.ldexp(limb.astype(float), high - LIMB * k)
    total = np.where(up > 0, math.inf, np.where(down > 0, -math.inf, total))
    return np.where((nan > 0) | ((up > 0) & (down > 0)), math.nan, total)


def sums_in_boxes(x, y, weights, x0, x1, y0, y1, closed: tuple[bool, bool]) -> np.ndarray:
    """Sums of the points' ``weights`` (a row of integers each) in each box.

    Points in order of x are sorted by their ranks of y a bit at a time, the highest first,
    and each box's run of them is followed to where its ranks are: of the ranks below a bound
    those that have 0 at a bit where the bound has 1 are a run of the points, and a difference
    of running totals.
    """
    sides = [("left", "right") if shut else ("right", "left") for shut in closed]
    order, levels = np.argsort(x, kind="stable"), np.sort(y)
    x, rank, weights = x[order], np.searchsorted(levels, y[order]), weights[order]
    low, high = (np.tile(np.searchsorted(x, v, side), 2) for v, side in zip((x0, x1), sides[0], strict=True))
    bottom, top = (np.searchsorted(levels, v, side) for v, side in zip((y0, y1), sides[1], strict=True))
    below, some = np.r_[top, bottom], np.flatnonzero(weights.any(0))
    width, weights = weights.shape[1], weights[:, some]
    found = np.zeros((len(below), len(some)), np.int64)
    total = np.zeros((len(x) + 1, len(some)), np.int64)
    for bit in range(len(x).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        order = np.argsort(one, kind="stable")
        rank, weights = rank[order], weights[order]
        np.cumsum(weights, axis=0, out=total[1:])
        left, right = zeros[low], zeros[high]
        up = np.flatnonzero((below >> bit) & 1)
        found[up] += total[right[up]] - total[left[up]]
        left[up], right[up] = zeros[-1] + low[up] - left[up], zeros[-1] + high[up] - right[up]
        low, high = left, right
    out = np.zeros((len(x0), width), np.int64)
    out[:, some] = found[: len(x0)] - found[len(x0) :]
    return out
