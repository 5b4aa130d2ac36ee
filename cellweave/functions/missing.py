"""Missing-value rules.

NULL is the only missing value. NaN is turned into NULL on ingest, ratios give
NULL on a zero denominator, and every aggregate states whether it skips missing
rows (the default) or lets one missing row make the whole group missing
(``strict``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: ColumnLike) -> Column:
    column = as_column(value)
    return F.when(~F.isnan(column), column)


def clean_measures(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the given (default: all floating) columns."""
    if columns is None:
        columns = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({name: nan_to_null(name) for name in columns})


def to_number(value: ColumnLike) -> Column:
    """Text to double; text that is no number becomes NULL instead of an error."""
    return as_column(value).try_cast("double")


def sum0(value: ColumnLike) -> Column:
    """Sum that skips missing rows; a group with no value sums to 0."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0.0))


def strict(aggregate: Column, *inputs: ColumnLike, over: WindowSpec | None = None) -> Column:
    """The aggregate, or NULL if any row of the group misses one of the inputs."""
    rows = F.count(F.lit(1))
    present = F.count(F.when(_all_present(inputs), F.lit(1)))
    if over is not None:
        rows, present, aggregate = rows.over(over), present.over(over), aggregate.over(over)
    return F.when(present == rows, aggregate)


def _all_present(inputs: Iterable[ColumnLike]) -> Column:
    condition = F.lit(True)
    for value in inputs:
        condition = condition & as_column(value).isNotNull()
    return condition


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def ratio_if_positive(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, NULL where the numerator is negative or the denominator is not positive."""
    n, d = as_column(numerator), as_column(denominator)
    return F.when((n >= 0) & (d > 0), F.try_divide(n, d))


def keep_between(value: ColumnLike, low: float, high: float) -> Column:
    """The value where it lies in the closed interval, else NULL."""
    column = as_column(value)
    return F.when(column.between(low, high), column)


def keep_nonnegative(value: ColumnLike) -> Column:
    column = as_column(value)
    return F.when(column >= 0, column)


def zero_to_null(value: ColumnLike) -> Column:
    return F.nullif(as_column(value), F.lit(0.0))


def cap(value: ColumnLike, limit: float) -> Column:
    """Upper limit that leaves NULL as NULL."""
    column = as_column(value)
    return F.when(column > limit, F.lit(float(limit))).otherwise(column)


def log10_positive(value: ColumnLike) -> Column:
    column = as_column(value)
    return F.when(column > 0, F.log10(column))
