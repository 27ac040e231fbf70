"""Exponential smoothing as running window sums.

A level that starts at the first observed value and then moves by
``level += rate * (x - level)`` has the closed form

    level_n = (1-rate)^n * sum_i c_i x_i (1-rate)^-i,   c_1 = 1, c_i = rate (i > 1)

with i the running count of observed values.  That is one running sum, so the whole
recursion is a window expression: no Python, no fold over time.

(1-rate)^-i grows without bound, so the exponent is restarted every
``block_length(rate)`` observations.  One earlier block is carried over; anything
older has a weight below 1e-200 and cannot change a double.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_length(rate: float) -> int:
    """Observations after which an old value's weight has fallen below 1e-200."""
    return max(1, int(200 * math.log(10) / -math.log1p(-rate)))


def with_smoothed_level(df: DataFrame, value: Column, observed: Column, rate: float, out: str, *,
                        by: list[str], order: str) -> DataFrame:
    """Add ``out``: the smoothed level of ``value`` after each row.

    ``observed`` marks rows that update the level, other rows repeat it.
    """
    n, term, i = f"__{out}_n", f"__{out}_t", f"__{out}_i"
    running = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    decay = math.log1p(-rate)
    size = block_length(rate)
    df = df.withColumn(n, F.count(F.when(observed, F.lit(1))).over(running))
    weight = F.when(F.col(n) == 1, F.lit(1.0)).otherwise(F.lit(rate))
    block = f"__{out}_b"
    inside = Window.partitionBy(*by, block).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(block).rangeBetween(-1, -1)
    df = (df.withColumn(block, F.floor((F.greatest(F.col(n), F.lit(1)) - 1) / size).cast("int"))
            .withColumn(i, (F.col(n) - F.col(block) * size).cast("double"))
            .withColumn(term, F.when(observed, weight * value * F.exp(-decay * F.col(i))))
            .withColumn(term, F.exp(decay * F.col(i)) * F.coalesce(F.sum(term).over(inside), F.lit(0.0))))
    carried = F.max(F.when(F.col(i) == size, F.col(term))).over(before)
    level = F.col(term) + F.coalesce(carried, F.lit(0.0)) * F.exp(decay * F.col(i))
    return df.withColumn(out, F.when(F.col(n) > 0, level)).drop(n, term, i, block)
