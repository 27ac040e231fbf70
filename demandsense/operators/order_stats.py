"""Exact quantiles of groups of any size, by rank refinement.

The built-in exact percentile keeps every distinct value of a group in one task.  Here a value becomes a
whole number that sorts alike, and a wanted rank is followed through its leading bits: one
aggregation counts the rows of each first piece, the piece that holds the rank is kept, the next round counts
the second pieces within it, and the last round ends at a single value.  Each round is one pass with map-side
counts for all groups and ranks together; what reaches one task is a count for each of at most ``2 ** STEP``
pieces, whatever the size of the group and however many of its values are equal.  All groups go the same way.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut

STEP = 22              # bits a round; 64 bits take three rounds
FEW = 100_000          # wanted ranks of all groups that are small enough to broadcast
_KEY = "__all"
# The parts of a double.
_FRACTION, _BIAS, _TOP = 52, 1023, 2047


def sortable(v: Column) -> Column:
    """A whole number for each double, in the order of the values; -0.0 and 0.0 are one, NaN is the last."""
    size = F.abs(v)
    near = F.greatest(F.least(F.floor(F.log2(size)), F.lit(_BIAS)), F.lit(1 - _BIAS))
    two = lambda e: F.pow(F.lit(2.0), e)
    power = near + F.when(two(near) > size, -1).when((near < _BIAS) & (two(near + 1) <= size), 1).otherwise(0)
    whole = (power + _BIAS) * F.lit(1 << _FRACTION) + ((size / two(power) - 1) * float(1 << _FRACTION)).cast("long")
    code = (F.when(F.isnan(v), F.lit((_TOP << _FRACTION) + 1)).when(size == float("inf"), F.lit(_TOP << _FRACTION))
            .when(size < 2.0 ** (1 - _BIAS), (size / 2.0 ** (1 - _BIAS - _FRACTION)).cast("long")).otherwise(whole))
    return F.when(v < 0, -code).otherwise(code)


def value_of(code: Column) -> Column:
    size = F.abs(code)
    power, part = F.shiftright(size, _FRACTION), size.bitwiseAND(F.lit((1 << _FRACTION) - 1)).cast("double")
    value = (F.when(power == 0, part * 2.0 ** (1 - _BIAS - _FRACTION)).when((power == _TOP) & (part > 0), F.lit(float("nan"))).when(power == _TOP, F.lit(float("inf")))
             .otherwise((1 + part / float(1 << _FRACTION)) * F.pow(F.lit(2.0), power - _BIAS)))
    return F.when(code < 0, -value).otherwise(value)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """(by..., n, tag, stat): the value at each wanted 1-based rank of each group.

    ``ranks(n)`` gives array<struct<tag, rank>>.  Rows with a missing value are left out; a group
    without any row has no result.
    """
    keys = list(by) or [_KEY]
    base = df if by else df.withColumn(_KEY, F.lit(0))
    base = cut(base.where(F.col(value).isNotNull()).select(*keys, sortable(F.col(value).cast("double")).alias("__v")))

    def within(counts: DataFrame, group: list[str]) -> DataFrame:
        """The rows below and up to each piece of its group."""
        w = Window.partitionBy(*group).orderBy("__next")
        return counts.withColumn("__hi", F.sum("__c").over(w)).withColumn("__lo", F.col("__hi") - F.col("__c"))

    shift = 2 * STEP
    counts = base.groupBy(*keys, F.shiftright("__v", shift).alias("__next")).agg(F.count(F.lit(1)).alias("__c"))
    first = within(counts, keys).withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
    hit = F.filter(ranks(F.col("n")), lambda r: (r["rank"] > F.col("__lo")) & (r["rank"] <= F.col("__hi")))
    held = first.select(*keys, "n", F.explode(hit).alias("__r"), F.col("__next").alias("__piece"), "__lo").select(
        *keys, "n", F.col("__r")["tag"].alias("tag"), "__piece", (F.col("__r")["rank"] - F.col("__lo")).alias("__rank"))
    held = cut(held)
    small = held.count() <= FEW
    while shift:
        wanted = held.select(*keys, "__piece").distinct()
        rows = base.withColumn("__piece", F.shiftright("__v", shift)).join(F.broadcast(wanted) if small else wanted, [*keys, "__piece"])
        shift -= STEP
        counts = rows.groupBy(*keys, "__piece", F.shiftright("__v", shift).alias("__next")).agg(F.count(F.lit(1)).alias("__c"))
        met = within(counts, [*keys, "__piece"]).join(F.broadcast(held) if small else held, [*keys, "__piece"])
        held = met.where((F.col("__rank") > F.col("__lo")) & (F.col("__rank") <= F.col("__hi"))).select(
            *keys, "n", "tag", F.col("__next").alias("__piece"), (F.col("__rank") - F.col("__lo")).alias("__rank"))
        held = cut(held) if shift else held
    out = held.select(*keys, "n", "tag", value_of(F.col("__piece")).alias("stat"))
    return out if by else out.drop(_KEY)


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by..., prob, q, n): exact quantiles with linear interpolation between the two
    neighbouring order statistics."""
    def wanted(n: Column) -> Column:
        out = []
        for i, p in enumerate(probs):
            below = F.floor(F.lit(float(p)) * (n - 1)) + 1
            out.append(F.struct(F.lit(2 * i).alias("tag"), below.alias("rank")))
            out.append(F.struct(F.lit(2 * i + 1).alias("tag"), F.least(below + 1, n).alias("rank")))
        return F.array(*out)

    stats = order_statistics(df, by, value, wanted)
    i = F.floor(F.col("tag") / 2).cast("int")
    pairs = stats.groupBy(*by, "n", i.alias("i")).agg(
        F.max(F.when(F.col("tag") % 2 == 0, F.col("stat"))).alias("lo"),
        F.max(F.when(F.col("tag") % 2 == 1, F.col("stat"))).alias("hi"))
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("i")]
    pos = prob * (F.col("n") - 1)
    return pairs.select(*by, prob.alias("prob"),
                        (F.col("lo") + (F.col("hi") - F.col("lo")) * (pos - F.floor(pos))).alias("q"), "n")


def group_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return group_quantiles(df, by, value, [0.5]).select(*by, F.col("q").alias(out))
