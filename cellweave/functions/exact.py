"""Sums and means of doubles that do not depend on the order of the rows.

A double is split without error into its whole part and a fraction, and the fraction into
whole 2**-60ths. Both are added as integers, which is exact in any order, and only the
finished sums are rounded. Fractions below 2**-60 are cut off, the same way for each value. Use them where a result must be the same bits on every run and on
every number of executors: plain sums differ in their last bits from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column

#: Parts of one.
PARTS = 1 << 60


def _parts(value: ColumnLike) -> tuple[Column, Column]:
    """Sums of the whole parts and of the fractions, as integers."""
    x = as_column(value).cast("double")
    whole = F.floor(x)
    part = F.floor((x - whole.cast("double")) * F.lit(float(PARTS)))
    return F.sum(whole.cast("decimal(38,0)")), F.sum(part.cast("decimal(38,0)"))


def exact_sum(value: ColumnLike) -> Column:
    """Sum that skips missing values; NULL for none. Values are finite and below 2**63."""
    whole, part = _parts(value)
    carry = F.floor(part / F.lit(PARTS).cast("decimal(38,0)"))
    rest = (part - carry.cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(20,0)")).cast("long")
    return (whole + carry).cast("double") + rest.cast("double") / F.lit(float(PARTS))


def exact_mean(value: ColumnLike) -> Column:
    """Mean that skips missing values; NULL for none."""
    count = F.count(as_column(value))
    return F.when(count > 0, exact_sum(value) / count.cast("double"))
