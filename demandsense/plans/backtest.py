"""Panel in, scored forecasts out."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandsense.operators import features, forecast, history, metrics
from demandsense.operators.features import Inputs
from demandsense.operators.layout import Layout, block_of

BASE_MODELS = ["b0", "b1", "croston", "sba", "tsb"]


def demand_classes(inp: Inputs, lay: Layout) -> DataFrame:
    return forecast.demand_classes(history.with_masked(inp.panel), lay.train_end)


def with_baselines(rows: DataFrame, classes: DataFrame) -> DataFrame:
    rows = forecast.with_planner(forecast.with_seasonal_naive(rows))
    return rows.join(classes.select("series_id", "demand_class"), "series_id", "left")


def base_rows(inp: Inputs, lay: Layout, blocks: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Seasonal naive, planner and intermittent forecasts of the given blocks with their
    targets; history statistics come out of one pass over the panel."""
    origins = [o for b in blocks for o in lay.block(b)]
    stats = features.origin_stats(inp, origins, lay.horizon, ["launch_idx", *keep])
    rows = features.horizon_rows(stats, inp, lay.horizon)
    rows = rows.withColumn("age", F.least(F.col("day") - F.col("launch_idx"), F.lit(features.MAX_AGE)))
    return with_baselines(rows, demand_classes(inp, lay)).withColumn("block", block_of(lay, F.col("origin")))


def routed(rows: DataFrame, cal: DataFrame, scale: DataFrame, models: Sequence[str], young_route: str = "c1") -> DataFrame:
    """Route on the calibration block, then apply to ``rows``."""
    return forecast.apply_routes(rows, forecast.select_routes(cal, scale), young_route, models)


def mase_scale(inp: Inputs, lay: Layout) -> DataFrame:
    return metrics.mase_scale(history.with_masked(inp.panel), lay.train_end)
