"""Scores and evaluation tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions import scores
from demandsense.functions.lineage import cut
from demandsense.functions.numeric import ratio
from demandsense.operators.history import with_seasonal_diff
from demandsense.operators.order_stats import group_median, group_quantiles
from demandsense.operators.panel import fill_gaps

# Rain of a heavy-rain day (mm), days after an event start that still count.
HEAVY_RAIN, EVENT_NEAR = 20.0, 4


def unpivot_models(rows: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    return rows.select(*ids, *[F.col(m).cast("double") for m in models]).unpivot(list(ids), list(models), "model", "forecast")


def mase_scale(panel: DataFrame, upto: int, period: int = 7) -> DataFrame:
    """(series_id, mase_scale): in-sample error of the seasonal naive forecast; series
    without a positive one take the median of the others, or 1."""
    diffs = with_seasonal_diff(panel.where(F.col("day_idx") <= upto).select("series_id", "day_idx", "ym"), period)
    own = diffs.groupBy("series_id").agg(F.avg("seasonal_diff").alias("__m"))
    own = cut(own.select("series_id", F.when(F.col("__m") > 0, F.col("__m")).alias("own_scale")))
    fallback = group_median(own, [], "own_scale", "fallback").agg(F.max("fallback").alias("fallback"))
    return own.join(F.broadcast(fallback)).select(           # one row
        "series_id", F.coalesce("own_scale", "fallback", F.lit(1.0)).alias("mase_scale"))


def mase_by(long: DataFrame, scale: DataFrame, by: Sequence[str], y: str = "y", f: str = "forecast") -> DataFrame:
    """(by..., mase, rows): mean over series of MAE / scale.  Two-level aggregation; the
    scale joins after the rows are reduced to one per (group, series)."""
    err = F.abs(F.col(y) - F.col(f))
    per = long.groupBy(*by, "series_id").agg(F.avg(err).alias("__mae"), F.count(F.lit(1)).alias("__n"))
    return (per.join(scale, "series_id").groupBy(*by)
            .agg(F.avg(F.col("__mae") / F.col("mase_scale")).alias("mase"), F.sum("__n").alias("rows")))


def score_block(rows: DataFrame, models: Sequence[str], scale: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """model x (wape, mase, bias) from one pass: sums per (model, series) feed all three."""
    long = unpivot_models(rows, [*by, "series_id", "y"], models)
    diff = F.col("forecast") - F.col("y")
    per = long.groupBy(*by, "model", "series_id").agg(
        F.sum(F.abs(diff)).alias("ae"), F.sum(diff).alias("e"), F.sum(F.abs("y")).alias("vol"), F.count(diff).alias("n"))
    return (per.join(scale, "series_id").groupBy(*by, "model")
            .agg(ratio(F.sum("ae"), F.sum("vol")).alias("wape"),
                 F.avg(F.col("ae") / F.col("n") / F.col("mase_scale")).alias("mase"),
                 ratio(F.sum("e"), F.sum("vol")).alias("bias")))


def with_previous_forecast(rows: DataFrame, forecast: str, out: str = "prev") -> DataFrame:
    """Forecast of the same (series, day) from the origin before."""
    w = Window.partitionBy("series_id", "day").orderBy("origin")
    return rows.withColumn(out, F.lag(forecast).over(w))


def stability(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, stability): median over series of sum|F - previous F| / sum|F| over rows that
    have a previous forecast; NULL for a model without such rows."""
    long = unpivot_models(rows, ["series_id", "origin", "day"], models)
    w = Window.partitionBy("model", "series_id", "day").orderBy("origin")
    moved = long.withColumn("prev", F.lag("forecast").over(w)).where("prev IS NOT NULL")
    per = moved.groupBy("model", "series_id").agg(
        (F.sum(F.abs(F.col("forecast") - F.col("prev"))) / F.greatest(F.sum(F.abs("forecast")), F.lit(1e-9))).alias("move"))
    names = rows.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return names.join(group_median(cut(per), ["model"], "move", "stability"), "model", "left")


def day_type(rain: Column) -> Column:
    event = (F.col("in_festival") == 1) | F.col("days_to_event").between(0, EVENT_NEAR)
    return (F.when(event, "festival").when(rain >= HEAVY_RAIN, "heavy_rain")
             .when(F.col("disc") > 0, "promotion").otherwise("normal"))


def wape_cuts(rows: DataFrame, models: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """(dimension, value, rows, wape per model) for each dimension, one pass (grouping sets)."""
    sets = [[F.col(d)] for d in dims]
    agg = rows.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("__g"), *[scores.wape("y", m).alias(f"wape_{m}") for m in models])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        own = (F.shiftright("__g", len(dims) - 1 - i) % 2) == 0
        name = F.when(own, F.lit(d)).otherwise(name)
        value = F.when(own, F.col(d).cast("string")).otherwise(value)
    return agg.select(name.alias("dimension"), value.alias("value"), "rows", *[f"wape_{m}" for m in models])


def store_mase(rows: DataFrame, panel: DataFrame, upto: int, models: Sequence[str]) -> DataFrame:
    """(model, store_mase): forecasts summed to store x origin x day, scaled by the store's
    own seasonal-naive error (missing item days count as 0)."""
    seen = panel.where(F.col("day_idx") <= upto).select("store_id", "day_idx", "ym")
    opening = panel.select("store_id").distinct().select("store_id", F.lit(0).alias("day_idx"), F.lit(0.0).alias("ym"))
    store_day = seen.unionByName(opening).groupBy("store_id", "day_idx").agg(F.coalesce(F.sum("ym"), F.lit(0.0)).alias("ym"))
    store_day = fill_gaps(store_day, upto, by=["store_id"], fill={"ym": 0.0})
    w = Window.partitionBy("store_id").orderBy("day_idx").rangeBetween(-7, -7)
    scale = (store_day.withColumn("d", F.abs(F.col("ym") - F.max("ym").over(w)))
             .groupBy("store_id").agg(F.avg("d").alias("mase_scale")).withColumnRenamed("store_id", "series_id"))
    agg = rows.groupBy(F.col("store_id").alias("series_id"), "origin", "day").agg(
        F.sum("y").alias("y"), *[F.sum(m).alias(m) for m in models])
    long = unpivot_models(agg, ["series_id", "y"], models)
    return mase_by(long, scale, ["model"]).select("model", F.col("mase").alias("store_mase"))


def truth_accuracy(rows: DataFrame, truth: DataFrame, keys: Sequence[str], model: str = "final", top: float = 0.9) -> DataFrame:
    """WAPE and bias of ``model`` against an alternate truth table, overall and for the
    top-volume series (mean demand at or above the ``top`` quantile)."""
    joined = rows.join(truth, list(keys), "left")
    per = joined.groupBy("series_id").agg(
        F.avg("demand").alias("mean_demand"),
        F.sum(F.abs(F.col(model) - F.col("demand"))).alias("ae"), F.sum(F.col(model) - F.col("demand")).alias("e"),
        F.sum(F.when(F.col(model).isNotNull(), F.abs("demand"))).alias("vol"))
    per = cut(per)
    bar = group_quantiles(per, [], "mean_demand", [top]).agg(F.max("q").alias("bar"))
    big = F.col("mean_demand") >= F.col("bar")
    return per.join(F.broadcast(bar)).agg(                   # one row
        ratio(F.sum("ae"), F.sum("vol")).alias("wape"), ratio(F.sum("e"), F.sum("vol")).alias("bias"),
        ratio(F.sum(F.when(big, F.col("e"))), F.sum(F.when(big, F.col("vol")))).alias("bias_top"),
        F.count_if(big).alias("top_series"))


def residual_sd(rows: DataFrame, series: DataFrame, forecast: str = "final") -> DataFrame:
    """(series_id, resid_sd): sample sd of y - forecast, the global one where undefined."""
    e = F.col("y") - F.col(forecast)
    own = rows.groupBy("series_id").agg(F.stddev_samp(e).alias("own"))
    overall = rows.agg(F.stddev_samp(e).alias("overall"))
    return (series.select("series_id").join(own, "series_id", "left").join(F.broadcast(overall))   # one row
            .select("series_id", F.coalesce("own", "overall").alias("resid_sd")))


def wape_by_level(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """level x method table of WAPE; ``rows`` holds level, y and one column per method."""
    return rows.where("y IS NOT NULL").groupBy("level").agg(*[scores.wape("y", m).alias(m) for m in methods])


def wape_table(rows: DataFrame, methods: Sequence[str], cuts: Sequence[str] = ()) -> DataFrame:
    """(level, <cuts>, rows, one column per method): WAPE by level, by level and each cut, and of all levels together.

    One scan: the forecasts of a row become one row a method, grouping sets sum errors and volumes over method x level x cut,
    and the few sums are turned round into a table.  A column that a line does not group by reads ``all``.
    """
    ids = ["level", *cuts]
    known = rows.where("y IS NOT NULL").select(*[F.col(c).cast("string").alias(c) for c in ids], F.col("y"), *[F.col(m).cast("double") for m in methods])
    long = known.unpivot([*ids, "y"], list(methods), "method", "forecast")
    sets = [["method"], ["method", "level"], *[["method", "level", c] for c in cuts]]
    sums = long.groupingSets([[F.col(c) for c in g] for g in sets], "method", *ids).agg(
        scores.wape("y", "forecast").alias("wape"), F.count(F.lit(1)).alias("rows"), *[F.grouping(c).alias(f"__g_{c}") for c in ids])
    named = sums.select("method", "wape", "rows", *[F.when(F.col(f"__g_{c}") == 1, F.lit("all")).otherwise(F.col(c)).alias(c) for c in ids])
    return named.groupBy(*ids, "rows").pivot("method", list(methods)).agg(F.max("wape"))


def evaluate_gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """PASS / FAIL / N/A per gate.  ``metrics``: (gate, value); ``thresholds``: (gate, low, high,
    strict) where a missing bound is open and ``strict`` excludes the bound itself."""
    v, strict = F.col("value"), F.col("strict")
    above = F.col("low").isNull() | F.when(strict, v > F.col("low")).otherwise(v >= F.col("low"))
    below = F.col("high").isNull() | F.when(strict, v < F.col("high")).otherwise(v <= F.col("high"))
    return (thresholds.join(metrics, "gate", "left")
            .select("gate", "value", "low", "high",
                    F.when(v.isNull(), "N/A").when(above & below, "PASS").otherwise("FAIL").alias("result")))
