"""Statistics over the runs of an ensemble and over ordered series.

Every table here has one row per (run, key), so a window partition holds one
row per run (``group_means``, ``group_envelope``), per month of a series
(``running_sum``, ``running_mean``) or per level (``bin_edges``). Cell tables
reach this module with a unique (phase, cell, time) key; their groups are as
small as the number of runs, wherever most of the rows lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column, strict
from cellweave.functions.physics import block_number
from cellweave.operators.lookup import attach_ordinal


def first_periods(
    df: DataFrame,
    count: int,
    phase: str = "phase",
    time: str = "time",
    out: str = "month",
    source: DataFrame | None = None,
) -> DataFrame:
    """Number the periods of each phase and keep the first ``count``."""
    return attach_ordinal(df, time, [phase], out, source).filter(F.col(out) <= count)


def number_rows(df: DataFrame, by: Sequence[str], order: str, out: str = "month") -> DataFrame:
    """1-based row number of a series with one row per period."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def group_means(
    df: DataFrame,
    keys: Sequence[str],
    averages: Mapping[str, ColumnLike],
    missing: str = "skip",
) -> DataFrame:
    """Attach to each row the mean over the runs that share its key."""
    window = Window.partitionBy(*keys)
    columns = {}
    for out, value in averages.items():
        mean = F.avg(as_column(value))
        columns[out] = (
            strict(mean, value, over=window) if missing == "strict" else mean.over(window)
        )
    return df.withColumns(columns)


def group_envelope(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach smallest and largest value over the runs; missing if any run is missing."""
    window = Window.partitionBy(*keys)
    columns = {}
    for value in values:
        columns[f"min_{value}"] = strict(F.min(value), value, over=window)
        columns[f"max_{value}"] = strict(F.max(value), value, over=window)
    return df.withColumns(columns)


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    window = (
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumn(out, F.sum(value).over(window))


def running_mean(value: ColumnLike, by: Sequence[str], order: str, size: int = 12) -> Column:
    """Mean of a row and the ``size`` - 1 rows after it; NULL when the window is not full."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(0, size - 1)
    column = as_column(value)
    return F.when(F.count(column).over(window) == size, F.avg(column).over(window))


def block_means(
    df: DataFrame, by: Sequence[str], index: str, averages: Mapping[str, str], size: int = 3
) -> DataFrame:
    """Attach the mean over fixed blocks of ``size`` periods."""
    blocked = df.withColumn("period", block_number(index, size))
    return group_means(blocked, [*by, "period"], averages)


def bin_edges(levels: DataFrame, depth: str = "depth") -> DataFrame:
    """Upper and lower edge of the layer around each level of a small distinct-level table."""
    d = F.col(depth)
    order = Window.orderBy(depth)
    above = F.lag(d, 1, 0.0).over(order)
    below = F.coalesce(F.lead(d).over(order), F.max(d).over(Window.partitionBy()))
    return levels.withColumns(
        {"depth_upper": (above + d) / 2, "depth_lower": (below + d) / 2}
    )


def repeat_last_period(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Add the last period of each series again under the next number, to close a step chart."""
    last = F.max(index).over(Window.partitionBy(*by))
    numbers = F.when(
        F.col(index) == F.col("_last"), F.array(F.col(index), F.col(index) + 1)
    ).otherwise(F.array(F.col(index)))
    return (
        df.withColumn("_last", last)
        .withColumn("_number", F.explode(numbers))
        .withColumn(index, F.col("_number"))
        .drop("_last", "_number")
    )
