"""Plot-ready slices of cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.missing import cap as cap_at
from cellweave.functions.missing import keep_between, keep_nonnegative, zero_to_null
from cellweave.functions.regions import Box


def map_slice(
    df: DataFrame,
    value: str,
    phase: str | None = None,
    month: int | None = None,
    box: Box | None = None,
    cap: float | None = None,
    blank_zero: bool = False,
    blank_negative: bool = False,
    valid: tuple[float, float] | None = None,
    divide_by: float = 1.0,
    ids: tuple[str, ...] = ("lat", "lon"),
) -> DataFrame:
    """One value of one phase and month, filtered, capped and scaled for a map."""
    if phase is not None:
        df = df.filter(F.col("phase") == phase)
    if month is not None:
        df = df.filter(F.col("month") == month)
    if box is not None:
        df = df.filter(box.holds("lat", "lon"))
    fill = F.col(value)
    if cap is not None:
        fill = cap_at(fill, cap)
    if blank_zero:
        fill = zero_to_null(fill)
    if blank_negative:
        fill = keep_nonnegative(fill)
    if valid is not None:
        fill = keep_between(fill, *valid)
    return df.select(*ids, (fill / F.lit(divide_by)).alias("fill"))
