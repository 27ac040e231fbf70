"""NULL-safe arithmetic shared by all operators.

Missing values are NULL everywhere; NaN is turned into NULL on read because Spark
treats NaN as the largest number in comparisons.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def clip(c: ColumnOrName, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least alone would drop it)."""
    out = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(col(c).isNotNull(), out)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, NULL when the denominator is 0 or missing."""
    return F.try_divide(col(num), col(den))


def is_true(pred: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(pred, F.lit(False))


def finite(c: ColumnOrName) -> Column:
    """The value if it is a finite number, else NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
