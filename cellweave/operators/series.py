"""Regional monthly series: climatology, anomalies, running means, correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.calendar import mid_month, month_of_year
from cellweave.functions.missing import ColumnLike, as_column, strict
from cellweave.operators.ensemble import running_mean
from cellweave.operators.lookup import attach_lookup


def monthly_series(
    df: DataFrame,
    averages: Mapping[str, ColumnLike],
    region: str = "region",
    moment: str = "ts",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Mean per region and month, dated at mid-month, and any ``extra`` aggregates."""
    return df.groupBy(region, mid_month(moment).alias("yr_mon")).agg(
        *[F.avg(as_column(value)).alias(out) for out, value in averages.items()],
        *[aggregate.alias(out) for out, aggregate in (extra or {}).items()],
    )


def quality_rule(df: DataFrame, region_value: str, condition: Column, region: str = "region"):
    """Apply a row filter to one region only."""
    return df.filter((F.col(region) != region_value) | condition)


def climatology(df: DataFrame, keys: Sequence[str], value: str, out: str, date: str = "yr_mon"):
    """Mean over all years per month of the year; missing if any year is missing."""
    return (
        df.withColumn("moy", month_of_year(date))
        .groupBy(*keys, "moy")
        .agg(strict(F.avg(value), value).alias(out))
    )


def anomalies(
    df: DataFrame, keys: Sequence[str], value: str, clim: str, anom: str, date: str = "yr_mon"
) -> DataFrame:
    """Attach the climatology and the difference from it."""
    window = Window.partitionBy(*keys, "moy")
    return (
        df.withColumn("moy", month_of_year(date))
        .withColumn(clim, strict(F.avg(value), value, over=window))
        .withColumn(anom, F.col(value) - F.col(clim))
    )


def lengthen(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long; rows with a missing value stay."""
    return df.unpivot(list(ids), list(values), name, value)


def widen(
    df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Long to wide for a known list of names, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value))


def running_means(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], date: str = "yr_mon", size: int = 12
) -> DataFrame:
    """Long form with each value replaced by its forward running mean."""
    long = lengthen(df, [date, *ids], values)
    return long.withColumn("value", running_mean("value", [*ids, "name"], date, size))


def against_reference(
    df: DataFrame,
    reference: DataFrame,
    value: str,
    date: str = "yr_mon",
) -> DataFrame:
    """Each series beside the reference series (columns ``date, reference``) on equal dates."""
    return df.join(reference, date, "inner").dropna("any", subset=[value, "reference"])


def beside_reference(df: DataFrame, is_reference: Column, value: str, date: str = "yr_mon") -> DataFrame:
    """Add ``reference``: the value of the series that is the reference, on equal dates.

    One pass: the window sees the few series of a date, and no row meets another in a join.
    """
    window = Window.partitionBy(date)
    return df.withColumn("reference", F.max(F.when(is_reference, F.col(value))).over(window))


def reference_series(df: DataFrame, region_value: str, value: str, region: str = "region"):
    return df.filter(F.col(region) == region_value).select(
        "yr_mon", F.col(value).alias("reference")
    )


def correlation(first: ColumnLike, second: ColumnLike, missing: str = "skip") -> Column:
    """Pearson correlation aggregate; ``strict`` makes it missing if any pair is incomplete."""
    a, b = as_column(first), as_column(second)
    value = F.corr(a, b)
    return strict(value, a, b) if missing == "strict" else value


def before(df: DataFrame, cutoff: str, date: str = "yr_mon") -> DataFrame:
    """Drop the periods from ``cutoff`` on."""
    return df.filter(F.col(date) < F.lit(cutoff).cast("date"))


def earliest(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows at the smallest time, overall or per group."""
    first = df.groupBy(*by).agg(F.min(time).alias(time))
    return attach_lookup(df, first, [*by, time], "left_semi")
