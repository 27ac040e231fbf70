"""A backtest on trained models: fit once, save, forecast block by block, score from the saved tables.

Everything is kept under one folder: ``models/<name>`` and ``forecasts``, a table partitioned by block.  A block is
forecast from the saved models alone, so it can be made again without training and without touching the other
blocks.  ``DONE`` is written last; a folder without it is made anew.

Models: ``t2`` Tweedie regression on all features, ``m1`` and ``m2`` boosted trees on sales-only and all features, and
quantile heads ``q10``, ``q50``, ``q90``: linear quantile regression around the boosted log ratio.  ``r10`` to ``r90`` are
the ratio heads that need no fit, to compare with.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.functions import scores
from demandsense.functions.lineage import checkpoint_dir, cut
from demandsense.operators import boosted, conformal, features, forecast, globalmodel, history, metrics, quantile_fit, robustness
from demandsense.operators.boosted import BoostedModel
from demandsense.operators.features import Inputs
from demandsense.operators.layout import Layout, block_of
from demandsense.operators.quantile_fit import QuantileModel
from demandsense.plans import backtest
from demandsense.sources import feeds

POINT = ["b0", "b1", "t2", "m1", "m2"]
HEADS = (10, 50, 90)
#: What the quantile heads see besides the boosted log ratio.
HEAD_FEATURES = ["ratio", "log_level", "spread", "zero28", "h", "lead", "disc", "in_festival", "is_holiday", "wx_missing"]
SCORED = ("cal", "test")
DONE = "done"


@dataclass
class Backtest:
    """Where a trained backtest lies."""

    folder: str
    inp: Inputs
    lay: Layout

    def forecasts(self, spark: SparkSession, *blocks: str) -> DataFrame:
        """The saved forecasts of some blocks; the filter prunes the table's folders."""
        rows = spark.read.parquet(f"{self.folder}/forecasts")
        return rows.where(F.col("block").isin(*blocks)) if blocks else rows


def head_features(rows: DataFrame) -> DataFrame:
    level = boosted.level()
    return rows.withColumns({"log_level": F.log(level + 1), "spread": F.coalesce("std28", F.lit(0.0)) / (level + 1), "lead": F.sqrt(F.col("h").cast("double"))})


def with_ratio_heads(rows: DataFrame, ratios: DataFrame, point: str = "m2") -> DataFrame:
    made = globalmodel.with_quantile_heads(rows, ratios, point)
    return made.withColumnsRenamed({f"{point}_p{p}": f"r{p}" for p in HEADS})


def with_quantiles(rows: DataFrame, model: QuantileModel) -> DataFrame:
    """q10, q50, q90: sorted so that they never cross, never negative."""
    heads = F.array_sort(F.array(*[boosted.back(c) for c in model.columns()]))
    return rows.withColumn("__q", heads).select(*rows.columns, *[F.col("__q")[i].alias(f"q{p}") for i, p in enumerate(HEADS)])


def train(inp: Inputs, lay: Layout, folder: str) -> None:
    """Fit every model on the training block and save it."""
    rows = cut(features.training_target(features.build_features(inp, lay.train, lay.horizon)))
    globalmodel.save_model(globalmodel.fit_point_model(rows, features.MULTISOURCE), f"{folder}/models/t2")
    boosted.fit_boosted(rows, features.SALES_ONLY).save(f"{folder}/models/m1")
    model = boosted.fit_boosted(rows, features.MULTISOURCE)
    model.save(f"{folder}/models/m2")
    classes = backtest.demand_classes(inp, lay).select("series_id", "demand_class")
    fitted = cut(model.ratios(rows, "ratio").withColumn("m2", boosted.back(F.col("ratio")) * model.factor).join(classes, "series_id", "left"))
    globalmodel.residual_ratio_quantiles(fitted).coalesce(1).write.mode("overwrite").parquet(f"{folder}/models/ratios")
    target = head_features(fitted).withColumn("__target", boosted.log_ratio(F.col("y_train")))
    quantile_fit.fit_quantiles(target, HEAD_FEATURES, "__target").save(f"{folder}/models/quantiles")


def forecast_block(spark: SparkSession, inp: Inputs, lay: Layout, folder: str, blocks: Sequence[str]) -> DataFrame:
    """Forecasts of ``blocks`` from the saved models."""
    rows = features.build_features(inp, [o for b in blocks for o in lay.block(b)], lay.horizon)
    rows = backtest.with_baselines(rows, backtest.demand_classes(inp, lay)).withColumn("block", block_of(lay, F.col("origin")))
    rows = globalmodel.load_model(spark, f"{folder}/models/t2").predict(rows, "t2")
    rows = BoostedModel.load(spark, f"{folder}/models/m1").predict(rows, "m1")
    model = BoostedModel.load(spark, f"{folder}/models/m2")
    rows = model.ratios(rows, "ratio").withColumn("m2", boosted.back(F.col("ratio")) * model.factor)
    rows = with_ratio_heads(rows, spark.read.parquet(f"{folder}/models/ratios"))
    return with_quantiles(head_features(rows), QuantileModel.load(spark, f"{folder}/models/quantiles")).drop("log_level", "spread", "lead")


def run(spark: SparkSession, inp: Inputs, lay: Layout, folder: str, blocks: Sequence[str] = SCORED) -> Backtest:
    """Train and forecast ``blocks`` unless the folder already holds them."""
    if feeds.existing_table(spark, f"{folder}/{DONE}") is None:
        train(inp, lay, folder)
        feeds.write_blocks(forecast_block(spark, inp, lay, folder, blocks), f"{folder}/forecasts")
        spark.createDataFrame([(b,) for b in blocks], "block string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{DONE}")
    return Backtest(folder, inp, lay)


def folder_for(spark: SparkSession, path: str) -> str:
    """One folder a session and input, so that queries of one session train once."""
    name = "".join(c if c.isalnum() else "-" for c in path)
    return f"{checkpoint_dir(spark).rstrip('/')}/trained-{spark.sparkContext.applicationId}{name}"


def point_scores(rows: DataFrame, scale: DataFrame, models: Sequence[str] = tuple(POINT)) -> DataFrame:
    """model, wape, mase, bias of the point models, in one table."""
    return metrics.score_block(forecast.usable(rows), list(models), scale)


def head_scores(rows: DataFrame) -> DataFrame:
    """kind, prob, pinball, below (share of sales at or under the head), rows: fitted heads beside ratio heads."""
    kept = forecast.usable(rows)
    names = [(kind, p, f"{kind[0]}{p}") for kind in ("quantile", "ratio") for p in HEADS]

    def told(kind: str, p: int, head: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(p / 100).alias("prob"), scores.pinball("y", head, p / 100).alias("pinball"),
                        F.avg((F.col("y") <= F.col(head)).cast("int")).alias("below"), F.count(F.lit(1)).alias("rows"))
    return kept.agg(F.array(*[told(*n) for n in names]).alias("s")).select(F.inline("s"))


# ------------------------------------------------------------------ what reads the saved forecasts
ROUTED = ["m2", "tsb", "sba", "croston"]
KEYS = ["series_id", "origin", "h"]
#: Rain forecast (log of 1 + mm) of a heavy-rain row.
HEAVY = math.log1p(metrics.HEAVY_RAIN)


def routed_bands(made: Backtest, spark: SparkSession) -> DataFrame:
    """Calibration and test rows with ``final``, its band and the conformal band (``p10c``, ``p90c``) fitted on the calibration block."""
    rows = made.forecasts(spark, *SCORED).withColumnsRenamed({f"q{p}": f"m2_p{p}" for p in HEADS})
    cal = rows.where("block = 'cal'")
    routes = forecast.select_routes(cal, backtest.mase_scale(made.inp, made.lay))
    final = cut(forecast.apply_routes(rows, routes, "m2", ROUTED))
    fitted = conformal.fit(forecast.usable(final.where("block = 'cal'")))
    return conformal.apply(final, fitted)


def weather_outage(made: Backtest, spark: SparkSession) -> DataFrame:
    """One row: WAPE of the boosted model with and without weather over the test block, beside the sales-only model.

    Passed: every row is flagged and the model without weather is still better than the one that never had any.
    """
    first, last = made.lay.test[0] + 1, made.lay.test[-1] + made.lay.horizon
    dark = replace(made.inp, weather=robustness.blank_weather(made.inp.weather, first, last))
    out = forecast_block(spark, dark, made.lay, made.folder, ["test"]).select(*KEYS, F.col("m2").alias("dark"), F.col("wx_missing").alias("flag"))
    rows = made.forecasts(spark, "test").join(out, KEYS)
    ok, rainy = F.col("y").isNotNull() & ~F.col("censored"), F.col("rain_fc") > HEAVY

    def wape(model: str, on: Column) -> Column:
        return scores.wape(F.when(on, F.col("y")), model)
    told = rows.agg(wape("m2", ok).alias("wape_normal"), wape("dark", ok).alias("wape_outage"), wape("m1", ok).alias("wape_sales_only"),
                    wape("m2", ok & rainy).alias("heavy_rain_normal"), wape("dark", ok & rainy).alias("heavy_rain_outage"),
                    F.sum("flag").alias("rows_flagged"), F.count(F.lit(1)).alias("rows"))
    return told.withColumn("passed", (F.col("wape_outage") < F.col("wape_sales_only")) & (F.col("rows_flagged") == F.col("rows")))


def search_spike(made: Backtest, spark: SparkSession, category: str) -> DataFrame:
    """One row (shift, passed): how far two days of spiked search before each origin move the forecasts of the series that read it."""
    loud = replace(made.inp, search=robustness.spike_search(made.inp.search, category, made.lay.test))
    keep = made.inp.series.where(F.col("search_key") == category).select("series_id")
    after = forecast_block(spark, loud, made.lay, made.folder, ["test"]).join(keep, "series_id", "left_semi")
    before = made.forecasts(spark, "test").join(keep, "series_id", "left_semi").select(*KEYS, "m2")
    return robustness.relative_shift(before, after, KEYS, "m2")


def censoring(inp: Inputs, lay: Layout, truth: DataFrame, keys: Sequence[str], treatments: Sequence[str] = ("ignore", "drop", "impute")) -> DataFrame:
    """treatment, bias and WAPE against true demand (``truth``: keys, ``demand``), WAPE of uncensored days, and whether it is the least biased."""
    train_rows, test = (cut(features.build_features(inp, o, lay.horizon)) for o in (lay.train[::2], lay.test))
    test = cut(test.join(truth, list(keys), "left"))
    parts = []
    for how in treatments:
        model = globalmodel.fit_point_model(features.training_target(train_rows, how), features.MULTISOURCE)
        seen = F.when(~F.col("censored"), F.col("y"))
        parts.append(model.predict(test, "f").agg(scores.bias("demand", "f").alias("bias"), scores.wape("demand", "f").alias("wape_true"), scores.wape(seen, "f").alias("wape_sales"))
                     .select(F.lit(how).alias("treatment"), "*"))
    out = cut(reduce(DataFrame.unionByName, parts))
    least = out.agg(F.min(F.abs("bias")).alias("least"))
    return out.join(F.broadcast(least)).select("treatment", "bias", "wape_true", "wape_sales", (F.abs("bias") == F.col("least")).alias("picked"))  # one row


def gate_values(made: Backtest, spark: SparkSession, rows: DataFrame, dry: DataFrame) -> list[DataFrame]:
    """(gate, value) of the gates that forecasts alone decide; ``rows`` from ``routed_bands``, ``dry`` its test rows with ``day_type``."""
    test = forecast.usable(rows.where("block = 'test'"))
    scale = backtest.mase_scale(made.inp, made.lay)
    planner = forecast.with_count_bands(test, "b1", None, "b1")
    whole = planner.agg(scores.wape("y", "final").alias("f"), scores.wape("y", "b0").alias("b"), scores.coverage("y", "p10c", "p90c").alias("cov"),
                        scores.mean_pinball("y", "p10c", "p50", "p90c").alias("pin"), scores.mean_pinball("y", "b1_p10", "b1_p50", "b1_p90").alias("pin1"))
    sensing = forecast.usable(dry).where(F.col("day_type").isin("festival", "heavy_rain")).agg(scores.wape("y", "m1").alias("m1"), scores.wape("y", "m2").alias("m2"))
    rare = metrics.score_block(test.where(F.col("demand_class").isin(*forecast.ROUTED_CLASSES)), ["final", "b0"], scale)
    store = metrics.store_mase(test, history.with_masked(made.inp.panel), made.lay.train_end, ["final"])
    moved = metrics.stability(rows.where("block = 'test' AND y IS NOT NULL"), ["final"])

    def values(df: DataFrame, **gates: Column) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), v.cast("double").alias("value")) for g, v in gates.items()])))
    return [values(whole, wape_gain_vs_b0=1 - F.col("f") / F.col("b"), coverage=F.col("cov"), pinball_gain_vs_b1=1 - F.col("pin") / F.col("pin1")),
            values(sensing, sensing_gain_event_days=1 - F.col("m2") / F.col("m1")),
            values(rare.agg(F.max(F.when(F.col("model") == "final", F.col("mase"))).alias("f"), F.max(F.when(F.col("model") == "b0", F.col("mase"))).alias("b")), mase_intermittent_vs_b0=F.col("f") / F.col("b")),
            values(store, mase_store=F.col("store_mase")), values(moved, stability=F.col("stability"))]
