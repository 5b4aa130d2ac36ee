"""Running sums and means of series that are too long for one task.

A window partitioned by series puts a whole series into one task. Here the rows of all
series are dealt by ranges of (series, order) and written once, so that both passes below
see the same ranges:

* running sums are taken within each range, and the totals of a series in the ranges
  before (one row per range and series) are added;
* for running means, the first rows of each range that continues a series are copied to
  the ranges before it, so that a window over the next rows finds them in its own range.

Rows of equal order are told apart by a number given before they are dealt, so that many
of them are dealt too; their order among themselves is arbitrary, as in any window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column
from cellweave.sources.shared import shared_root
from cellweave.sources.tables import stage

RANGE, TELL = "_range", "_tell"


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt by ranges of its order and written to the shared folder, with the
    number of the range and a number that tells equal rows apart."""
    told = df.withColumn(TELL, F.monotonically_increasing_id())
    dealt = told.repartitionByRange(*by, *order, TELL)
    return stage(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges", shared_root(df.sparkSession))


def running_totals(
    ranges: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, ColumnLike]
) -> DataFrame:
    """Add to a table of ``in_ranges`` the sum of each value up to each row of its series."""
    up_to = Window.partitionBy(RANGE, *by).orderBy(*order, TELL).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_carried_{out}": value for out, value in sums.items()}
    totals = ranges.groupBy(RANGE, *by).agg(*[F.sum(as_column(v)).alias(name) for name, v in carried.items()])
    before = totals.select(
        *[F.col(c).alias(f"_of_{c}") for c in (RANGE, *by)], *[F.sum(name).over(earlier).alias(name) for name in carried]
    )
    within = ranges.withColumns({out: F.sum(as_column(value)).over(up_to) for out, value in sums.items()})
    joined = within.join(before, _same([RANGE, *by]))
    added = joined.withColumns({out: _added(F.col(out), F.col(f"_carried_{out}")) for out in sums})
    return added.drop(*carried, *[f"_of_{c}" for c in (RANGE, *by)])


def running_averages(
    ranges: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    averages: Mapping[str, ColumnLike],
    size: int = 12,
) -> DataFrame:
    """Add to a table of ``in_ranges`` the mean of each row and the ``size`` - 1 rows after
    it in its series; NULL where the window is not full or a value is missing."""
    sort = [*order, TELL]
    values = {f"_value_{out}": as_column(value) for out, value in averages.items()}
    rows = ranges.withColumns({**values, "_own": F.lit(True)})
    copies = _following(rows.select(RANGE, *by, *sort, *values), by, sort, list(values), size - 1)
    whole = rows.unionByName(copies.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    ahead = Window.partitionBy(RANGE, *by).orderBy(*sort).rowsBetween(0, size - 1)
    means = {
        out: F.when(F.count(f"_value_{out}").over(ahead) == size, F.avg(f"_value_{out}").over(ahead))
        for out in averages
    }
    return whole.withColumns(means).filter("_own").drop("_own", *values)


def _following(rows: DataFrame, by: Sequence[str], sort: list[str], values: list[str], count: int) -> DataFrame:
    """For each range and series the first ``count`` rows of the series after the range.

    They are among the first ``count`` rows of the later ranges; only series that reach
    into several ranges have any, so there are about ``count`` rows for each range.
    """
    first = Window.partitionBy(RANGE, *by).orderBy(*sort)
    heads = rows.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= count)
    spans = heads.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("_heads"))
    series = Window.partitionBy(*by)
    spans = spans.withColumn("_ranges", F.count(F.lit(1)).over(series)).filter("_ranges > 1")
    spans = spans.select(*[F.col(c).alias(f"_of_{c}") for c in (RANGE, *by)])
    heads = heads.join(spans, _same([RANGE, *by]), "left_semi")
    item = F.struct(*sort, *values)
    ordered = series.orderBy(RANGE, "_place")
    after = F.collect_list(item).over(ordered.rowsBetween(1, count))
    last = F.row_number().over(Window.partitionBy(*by, RANGE).orderBy(F.desc("_place"))) == 1
    ends = heads.withColumn("_after", after).withColumn("_last", last).filter("_last")
    return ends.select(RANGE, *by, F.explode("_after").alias("_item")).select(
        RANGE, *by, *[F.col(f"_item.{c}").alias(c) for c in (*sort, *values)]
    )


def _same(keys: Sequence[str]) -> Column:
    """Keys equal to their counterparts ``_of_``; NULL is a series like any other."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return condition


def _added(own: Column, carried: Column) -> Column:
    """Sum of two sums, of which each may be missing."""
    return F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0)))
