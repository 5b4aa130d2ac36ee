"""Time labels and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column

# Seconds from 1970-01-01 to 1979-01-01, and from 0001-01-01 to 1979-01-01.
EPOCH_1979 = 283_996_800
YEAR_ONE_TO_1979 = 62_419_593_600
DAY_SECONDS = 86_400


def year_month(text: ColumnLike) -> Column:
    """``YYYY-MM`` of a datetime string; trailing clock time is ignored."""
    return F.date_format(F.try_to_date(F.left(as_column(text), F.lit(10)), "yyyy-MM-dd"), "yyyy-MM")


def month_label(moment: ColumnLike) -> Column:
    """``YYYY-MM`` of a date or timestamp."""
    return F.date_format(as_column(moment), "yyyy-MM")


def month_start(moment: ColumnLike) -> Column:
    """First day of the month: a 4-byte grouping key, cheaper than a label."""
    return F.trunc(as_column(moment), "MM")


def from_seconds_1979(seconds: ColumnLike) -> Column:
    """Seconds since 1979-01-01 UTC to a timestamp."""
    return F.timestamp_seconds(as_column(seconds) + F.lit(EPOCH_1979))


def seconds_1979_from_year_one(seconds: ColumnLike) -> Column:
    """Move a seconds count from the 0001-01-01 origin to the 1979-01-01 origin."""
    return as_column(seconds) - F.lit(YEAR_ONE_TO_1979)


def parse_datetime(text: ColumnLike) -> Column:
    return F.try_to_timestamp(as_column(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def mid_month(moment: ColumnLike) -> Column:
    """The 15th of the month of a date or timestamp."""
    column = as_column(moment)
    return F.make_date(F.year(column), F.month(column), F.lit(15))


def month_of_year(moment: ColumnLike) -> Column:
    return F.month(as_column(moment))


def month_date(label: ColumnLike) -> Column:
    """First day of a ``YYYY-MM`` month."""
    return F.try_to_date(F.concat(as_column(label), F.lit("-01")), "yyyy-MM-dd")


def month_seconds(moment: ColumnLike) -> Column:
    """Number of seconds in the month of a date."""
    return F.day(F.last_day(as_column(moment))) * F.lit(DAY_SECONDS)
