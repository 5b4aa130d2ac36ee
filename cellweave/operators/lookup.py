"""Small lookup tables and ordinals, without a job while a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a table with a lookup; adaptive execution measures it and picks the join."""
    return df.join(lookup, list(keys), how)


def ordered_values(df: DataFrame, value: str, by: str) -> Column:
    """The sorted distinct values of each group, as one map for use in any expression.

    It is an uncorrelated scalar subquery: it runs with the query that uses it, at most
    once, and what it carries is one entry per group and value, never rows of the table.
    The values are distinct months or levels, so groups are few and short.
    """
    held = df.groupBy(by).agg(F.sort_array(F.collect_set(value)).alias("_values"))
    return held.agg(F.map_from_entries(F.collect_list(F.struct(by, "_values")))).scalar()


def first_values(df: DataFrame, value: str, by: str, size: int) -> Column:
    """The distinct values among the first ``size`` of each group, as one array (a scalar subquery)."""
    held = df.groupBy(by).agg(F.sort_array(F.collect_set(value)).alias("_values"))
    early = held.select(F.explode(F.slice("_values", 1, size)).alias("_value"))
    return early.agg(F.collect_set("_value")).scalar()


def ordinal_in(values: Column, by: str, value: str) -> Column:
    """1-based place of ``value`` among its group's ``ordered_values``; NULL if absent."""
    place = F.array_position(F.element_at(values, F.col(by)), F.col(value))
    return F.nullif(place, F.lit(0)).cast("int")


def ordinal_table(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "ordinal"):
    """1-based rank of each distinct value, per group of ``by``.

    Only the distinct values are ranked: the window sees one row per period or
    level, never the cells.
    """
    distinct = df.select(*by, value).distinct()
    return distinct.withColumn(
        out, F.row_number().over(Window.partitionBy(*by).orderBy(value)).cast("int")
    )


def attach_ordinal(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    out: str = "ordinal",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the ordinal of ``value``; ``source`` is a cheaper table with the same values."""
    table = ordinal_table(source if source is not None else df, value, by, out)
    return attach_lookup(df, table, [*by, value])
