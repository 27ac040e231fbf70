"""Accuracy scores as aggregate expressions: use them inside any groupBy().agg()."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandsense.functions.numeric import ColumnOrName, col, ratio


def _paired(value: Column, *needed: Column) -> Column:
    """Value only where every input is present, so sums skip incomplete rows alike."""
    ok = needed[0].isNotNull()
    for c in needed[1:]:
        ok = ok & c.isNotNull()
    return F.when(ok, value)


def wape(y: ColumnOrName, f: ColumnOrName) -> Column:
    """sum|y-f| / sum|y|, NULL when there is no volume."""
    y, f = col(y), col(f)
    return ratio(F.sum(F.abs(y - f)), F.sum(_paired(F.abs(y), y, f)))


def bias(y: ColumnOrName, f: ColumnOrName) -> Column:
    """sum(f-y) / sum|y|, NULL when there is no volume."""
    y, f = col(y), col(f)
    return ratio(F.sum(f - y), F.sum(_paired(F.abs(y), y, f)))


def pinball(y: ColumnOrName, q: ColumnOrName, tau: float) -> Column:
    d = col(y) - col(q)
    return F.avg(_paired(F.greatest(tau * d, (tau - 1.0) * d), d))


def mean_pinball(y: ColumnOrName, q10: ColumnOrName, q50: ColumnOrName, q90: ColumnOrName) -> Column:
    return (pinball(y, q10, 0.1) + pinball(y, q50, 0.5) + pinball(y, q90, 0.9)) / 3.0


def coverage(y: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    return F.avg(col(y).between(col(lo), col(hi)).cast("int"))
