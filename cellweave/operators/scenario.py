"""Treated runs against the control run, and one grid against another."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column, ratio, sum0


def stack_runs(runs: Mapping[str, DataFrame], label: str = "phase") -> DataFrame:
    """Runs under one another with their name as a column; missing columns become NULL."""
    stacked = None
    for name, run in runs.items():
        run = run.withColumn(label, F.lit(name))
        stacked = run if stacked is None else append_rows(stacked, run)
    return stacked


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables by column name; duplicates stay, missing columns become NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def pair_with_control(
    treated: DataFrame,
    control: DataFrame,
    keys: Sequence[str],
    differences: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Every treated row with its control row, and treated minus control.

    ``control`` carries its own measure names (suffix ``_con``) and has one row
    per key. All phases are paired in one join: the control is shuffled once on
    the cell key, whatever the number of treated runs.
    """
    return with_differences(treated.join(control, list(keys), "left"), differences)


def with_differences(df: DataFrame, differences: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{out: (a, b)}`` to a minus b."""
    return df.withColumns({out: F.col(a) - F.col(b) for out, (a, b) in differences.items()})


def pair_runs(
    rows: DataFrame,
    keys: Sequence[str],
    run: str,
    runs: Sequence[str],
    control: str,
    measures: Mapping[str, ColumnLike],
    label: str = "phase",
    mean: Callable[[Column], Column] = F.avg,
) -> DataFrame:
    """Pair treated runs with the control when all of them are rows of one table.

    The mean of each measure is taken per key and run in a single grouping: one
    scan and one shuffle, where separate tables need a scan and a shuffle per
    side. Rows combine per key before the shuffle, so a key that holds a large
    share of the rows arrives as one partial row per task. The result has one
    row per key and treated run, with control means under the suffix ``_con``. A run that
    is not among ``runs`` is an error: it would be lost.
    """
    names = (*runs, control)
    aggregates = []
    for i, name in enumerate(names):
        here = F.col(run) == name
        aggregates.append(F.count(F.when(here, F.lit(1))).alias(f"_rows_{i}"))
        for out, value in measures.items():
            aggregates.append(mean(F.when(here, as_column(value))).alias(f"_{out}_{i}"))
    unknown = F.concat(F.lit("unknown run: "), F.coalesce(F.col(run).cast("string"), F.lit("NULL")))
    known = F.when(F.col(run).isin(*names), F.lit(True)).otherwise(F.raise_error(unknown).cast("boolean"))
    wide = rows.filter(known).groupBy(*keys).agg(*aggregates)
    treated = F.array(
        *[
            F.when(
                F.col(f"_rows_{i}") > 0,
                F.struct(
                    F.lit(name).alias(label),
                    *[F.col(f"_{out}_{i}").alias(out) for out in measures],
                ),
            )
            for i, name in enumerate(runs)
        ]
    )
    last = len(runs)
    return (
        wide.select(
            *keys,
            *[F.col(f"_{out}_{last}").alias(f"{out}_con") for out in measures],
            F.explode(treated).alias("_run"),
        )
        .filter(F.col("_run").isNotNull())
        .select(
            f"_run.{label}",
            *keys,
            *[f"_run.{out}" for out in measures],
            *[f"{out}_con" for out in measures],
        )
    )


def join_variables(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two variables of one run, where both exist."""
    return first.join(second, list(keys), "inner")


def merge_runs(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both runs; the key list is explicit, so measures never join."""
    return first.join(second, list(keys), "full")


def drop_land(df: DataFrame, measures: Iterable[str]) -> DataFrame:
    """Drop cells where any of the measures is missing."""
    return df.dropna("any", subset=list(measures))


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error where a key is missing: NULL keys would meet no partner in a join."""
    for key in keys:
        missing = F.raise_error(F.lit(f"missing key: {key}")).cast("boolean")
        df = df.filter(F.when(F.col(key).isNotNull(), F.lit(True)).otherwise(missing))
    return df


def missing_share(
    whole: DataFrame, part: DataFrame, keys: Sequence[str], total: str
) -> DataFrame:
    """How much of the total on one grid is missing from another, per key."""
    left = whole.select(*keys, F.col(total).alias(f"{total}_whole"))
    right = part.select(*keys, F.col(total).alias(f"{total}_part"))
    return _with_share(left.join(right, list(keys), "inner"), total)


def share_outside(
    df: DataFrame, keys: Sequence[str], amount: str, inside: Column, total: str
) -> DataFrame:
    """``missing_share`` of a grid and a part of the same grid, in one grouping.

    Keys without a cell inside have no counterpart and drop out.
    """
    both = df.groupBy(*keys).agg(
        sum0(amount).alias(f"{total}_whole"),
        sum0(F.when(inside, F.col(amount))).alias(f"{total}_part"),
        F.count(F.when(inside, F.lit(1))).alias("_inside"),
    )
    return _with_share(both.filter(F.col("_inside") > 0).drop("_inside"), total)


def _with_share(df: DataFrame, total: str) -> DataFrame:
    return df.withColumn(
        "difference", F.col(f"{total}_whole") - F.col(f"{total}_part")
    ).withColumn("share_missing", ratio("difference", f"{total}_whole"))
