"""Per-series statistics "as of day t, from days up to t" as range-frame windows.

Range frames count days, not rows, so sparse panels need no densifying; ``with_origins``
adds a marker row per (series, origin) so a state can be read on a day without sales.
Statistics wanted only at origins come from ``trailing_at_origins``, one aggregation.
"""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandsense.functions.numeric import clip, ratio
from demandsense.functions.smoothing import with_smoothed_level

SERIES = ["series_id"]
NEVER_SOLD = 90


def trailing(days: int, by: Sequence[str] = SERIES, order: str = "day_idx"):
    return Window.partitionBy(*by).orderBy(order).rangeBetween(-(days - 1), 0)


def up_to_now(by: Sequence[str] = SERIES, order: str = "day_idx"):
    return Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)


def with_masked(panel: DataFrame) -> DataFrame:
    """``ym``: units with stockout days set missing (sales under-count demand there)."""
    return panel.withColumn("ym", F.when(~F.coalesce("stockout", F.lit(False)), F.col("y")))


def at_least(value: Column, counted: Column, window, k: int) -> Column:
    return F.when(F.count(counted).over(window) >= k, value)


def with_rolling(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """mean7/28/56, std28, zero28, last_obs of ``ym`` and days_since_sale of ``y`` on every row."""
    ym = F.col("ym")
    now = Window.partitionBy(*by).orderBy("day_idx").rangeBetween(0, 0)
    w28 = trailing(28, by)
    return with_days_since_sale(df, by).select(
        "*",
        *[F.avg(ym).over(trailing(w, by)).alias(f"mean{w}") for w in (7, 28, 56)],
        F.stddev_samp(ym).over(w28).alias("std28"),
        F.avg((ym == 0).cast("int")).over(w28).alias("zero28"),
        F.max(ym).over(now).alias("last_obs"))


def weekday_value(arr: str, day: Column) -> Column:
    """Entry of an array indexed by day_idx mod 7: every weekday occurs four times in 28 days
    and once in 7, so same-weekday lags for any horizon are look-ups at the origin."""
    return F.get(F.col(arr), F.pmod(day, F.lit(7)))


def with_origins(panel: DataFrame, series: DataFrame, origins: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Panel rows plus one marker row per (series, origin); markers carry the series
    columns in ``keep`` and ``is_origin`` = true."""
    rows = panel.select("series_id", "day_idx", "y", "stockout", *[F.lit(None).cast(dict(series.dtypes)[c]).alias(c) for c in keep],
                        F.lit(False).alias("is_origin"))
    marks = series.select("series_id", F.explode(F.array(*[F.lit(int(o)) for o in origins])).alias("day_idx"),
                          F.lit(None).cast("double").alias("y"), F.lit(None).cast("boolean").alias("stockout"),
                          *keep, F.lit(True).alias("is_origin"))
    return rows.unionByName(marks)


def origin_reach(spark: SparkSession, origins: Sequence[int], back: int, ahead: int) -> DataFrame:
    """(day_idx, origin, ago): the days each origin can reach, ``back`` days of history and
    ``ahead`` target days (ago < 0).  len(origins) x (back + ahead) rows, whatever the data."""
    rows = [(o - a, o, a) for o in map(int, origins) for a in range(-ahead, back)]
    day, origin, ago = (pa.array(c, pa.int32()) for c in zip(*rows))
    return spark.createDataFrame(pa.table({"day_idx": day, "origin": origin, "ago": ago}))


def trailing_at_origins(panel: DataFrame, origins: Sequence[int], ahead: int = 0) -> DataFrame:
    """(series_id, origin, mean7/28/56, std28, zero28, last_obs, sdw_mean, sdw_last[, next_y, next_stockout]).

    A sliding window would touch every day of every series w times over; here each row only
    goes to the origins that see it (a join with a tiny table) and one partial aggregation
    gives all statistics.  ``next_*`` are the ``ahead`` target days, kept apart from history.
    ``panel`` has ``ym``.
    """
    reach = origin_reach(panel.sparkSession, origins, 56, ahead)
    rows = panel.join(F.broadcast(reach), "day_idx")           # bounded by origins x 70 days
    ago, ym, weekday = F.col("ago"), F.col("ym"), F.pmod("day_idx", F.lit(7))

    def within(days: int, value: Column = ym, weekday_is: int | None = None) -> Column:
        hit = ago.between(0, days - 1)
        return F.when(hit if weekday_is is None else hit & (weekday == weekday_is), value)

    aggs = [*[F.avg(within(w)).alias(f"mean{w}") for w in (7, 28, 56)],
            F.stddev_samp(within(28)).alias("std28"), F.avg(within(28, (ym == 0).cast("int"))).alias("zero28"),
            F.max(within(1)).alias("last_obs"),
            *[F.avg(within(28, ym, k)).alias(f"__m{k}") for k in range(7)],
            *[F.max(within(7, ym, k)).alias(f"__l{k}") for k in range(7)],
            *[F.max(F.when(ago == -h, F.col("y"))).alias(f"__y{h}") for h in range(1, ahead + 1)],
            *[F.max(F.when(ago == -h, F.col("stockout"))).alias(f"__s{h}") for h in range(1, ahead + 1)]]
    out = rows.groupBy("series_id", "origin").agg(*aggs)
    arrays = {"sdw_mean": [f"__m{k}" for k in range(7)], "sdw_last": [f"__l{k}" for k in range(7)]}
    if ahead:
        arrays |= {"next_y": [f"__y{h}" for h in range(1, ahead + 1)], "next_stockout": [f"__s{h}" for h in range(1, ahead + 1)]}
    return out.select(*[c for c in out.columns if not c.startswith("__")], *[F.array(*cs).alias(n) for n, cs in arrays.items()])


def with_days_since_sale(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Days since the last positive (unmasked) sale, capped; NULL before the first observation."""
    y, day, seen = F.col("y"), F.col("day_idx"), up_to_now(by)
    last_sale = F.max(F.when(y > 0, day)).over(seen)
    return df.withColumn("days_since_sale", F.when(
        F.count(y).over(seen) > 0, F.coalesce(F.least(day - last_sale, F.lit(NEVER_SOLD)), F.lit(NEVER_SOLD))))


def with_ses_level(df: DataFrame, alpha: float = 0.1, by: Sequence[str] = SERIES) -> DataFrame:
    return with_smoothed_level(df, F.col("ym"), F.col("ym").isNotNull(), alpha, "level", by=list(by),
                               order="day_idx")


def with_intermittent(df: DataFrame, alpha: float = 0.1, beta: float = 0.1,
                      by: Sequence[str] = SERIES) -> DataFrame:
    """croston, sba and tsb forecasts after each day; missing days leave the state alone.

    Demand size and interval are smoothed over positive days, the demand probability over
    observed days, starting at 0.25 (or 0.75 when the first observed day sold).  The size
    TSB uses follows the same path as Croston's, so one column serves both.
    """
    seen = up_to_now(by)
    before = Window.partitionBy(*by).orderBy("day_idx").rangeBetween(Window.unboundedPreceding, -1)
    ym = F.col("ym")
    df = df.withColumn("__obs_n", F.count(ym).over(seen))
    df = df.withColumn("__gap", F.col("__obs_n") - F.coalesce(
        F.max(F.when(ym > 0, F.col("__obs_n"))).over(before), F.lit(0)))
    sold = F.coalesce(ym > 0, F.lit(False))
    opts = dict(by=list(by), order="day_idx")
    df = with_smoothed_level(df, ym, sold, alpha, "__size", **opts)
    df = with_smoothed_level(df, F.col("__gap").cast("double"), sold, alpha, "__interval", **opts)
    chance = F.when(F.col("__obs_n") == 1, 0.25 + 0.5 * sold.cast("double")).otherwise(sold.cast("double"))
    df = with_smoothed_level(df, chance, ym.isNotNull(), beta, "__prob", **opts)
    croston = F.coalesce(ratio("__size", "__interval"), F.lit(0.0))
    return df.select(*[c for c in df.columns if not c.startswith("__")],
                     croston.alias("croston"), (croston * (1 - alpha / 2)).alias("sba"),
                     F.coalesce(F.col("__prob") * F.col("__size"), F.lit(0.0)).alias("tsb"))


def search_stats(search: DataFrame) -> DataFrame:
    """Bot-resistant search features per (category, day): a 5-day median, a 7-day mean, the
    ratio of 5- to 28-day medians (clipped to 0..5) and the 7- minus 28-day mean.

    ``search`` needs a row for every day that is read later; values may be missing.
    """
    by = ["category"]
    x = F.col("search_index")
    w5, w7, w28 = (trailing(d, by) for d in (5, 7, 28))
    df = search.select(
        "category", "day_idx", F.percentile(x, F.lit(0.5)).over(w5).alias("search_o"),
        at_least(F.percentile(x, F.lit(0.5)).over(w28), x, w28, 7).alias("__med28"),
        F.avg(x).over(w7).alias("search_mean7"),
        at_least(F.avg(x).over(w28), x, w28, 7).alias("__mean28"))
    return df.select("category", "day_idx", "search_o", "search_mean7",
                     clip(F.col("search_o") / F.when(F.col("__med28").isNotNull(), F.greatest("__med28", F.lit(1e-3))), 0, 5).alias("search_ratio"),
                     (F.col("search_mean7") - F.col("__mean28")).alias("search_trend"))


def climatology(weather: DataFrame, upto: int, values: Sequence[str] = ("temp_max", "rain_mm", "humidity"),
                start=None) -> DataFrame:
    """(city, month, value...): mean of the month over days <= ``upto``; a month without a
    value falls back to the city's overall mean."""
    seen = weather.where(F.col("day_idx") <= upto).withColumn("month", F.month(F.date_add(F.lit(start), F.col("day_idx"))))
    months = seen.groupBy("city", "month").agg(
        *[F.sum(v).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"n_{v}") for v in values])
    overall = (months.groupBy("city").agg(*[ratio(F.sum(f"s_{v}"), F.sum(f"n_{v}")).alias(f"all_{v}") for v in values])
               .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    return overall.join(months, ["city", "month"], "left").select(
        "city", "month",
        *[F.coalesce(ratio(f"s_{v}", f"n_{v}"), F.col(f"all_{v}")).alias(v) for v in values])


def with_seasonal_diff(df: DataFrame, period: int = 7, by: Sequence[str] = SERIES) -> DataFrame:
    """|ym(t) - ym(t - period)| by calendar day; NULL when either is missing."""
    back = Window.partitionBy(*by).orderBy("day_idx").rangeBetween(-period, -period)
    return df.withColumn("seasonal_diff", F.abs(F.col("ym") - F.max("ym").over(back)))


def last_rows(df: DataFrame, by: Sequence[str], order: Column, k: int) -> DataFrame:
    """Latest ``k`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
