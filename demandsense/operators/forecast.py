"""Baseline forecasts, demand classes, routing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.counts import count_quantiles, poisson_quantiles
from demandsense.functions.numeric import ratio
from demandsense.operators.metrics import mase_by, unpivot_models

# Class cuts, minimum history, routing candidates and row floors.
ADI_CUT, CV2_CUT, MIN_OBSERVED = 1.32, 0.49, 28
ROUTED_CLASSES = ("intermittent", "lumpy")
ROUTE_CANDIDATES = ("m2", "tsb", "sba", "croston")
YOUNG_CANDIDATES = ("m2", "c1", "catmean")
MIN_ROUTE_ROWS, MIN_YOUNG_ROWS, YOUNG_AGE = 50, 30, 28


def with_seasonal_naive(rows: DataFrame, out: str = "b0") -> DataFrame:
    """Same weekday of the latest week, else mean7, else 0."""
    return rows.withColumn(out, F.coalesce("sdw_last1", "mean7", F.lit(0.0)))


def with_planner(rows: DataFrame, out: str = "b1") -> DataFrame:
    """Smoothed level times a half-shrunk weekday index, never negative."""
    index = F.coalesce(1 + 0.5 * (ratio("sdw_mean4", "mean28") - 1), F.lit(1.0))
    return rows.withColumn(out, F.greatest(F.coalesce(F.col("level") * index, F.lit(0.0)), F.lit(0.0)))


def with_count_bands(rows: DataFrame, mean: str, std: str | None, prefix: str) -> DataFrame:
    """<prefix>_p10/_p50/_p90 of the count distribution with this mean (and std)."""
    q = count_quantiles(F.col(mean), F.col(std) if std else None)
    rows = rows.withColumn("__q", q)
    return rows.select(*[c for c in rows.columns if c != "__q"],
                       *[F.col("__q")[i].alias(f"{prefix}_{n}") for i, n in enumerate(("p10", "p50", "p90"))])


def demand_classes(panel: DataFrame, upto: int, adi_cut: float = ADI_CUT, cv2_cut: float = CV2_CUT) -> DataFrame:
    """smooth / erratic / intermittent / lumpy by interval and size variation, ``new`` under
    28 observations.  ``panel``: series_id, day_idx, ym.  One partial aggregation."""
    size = F.when(F.col("ym") > 0, F.col("ym"))
    agg = (panel.where(F.col("day_idx") <= upto).groupBy("series_id")
           .agg(F.count("ym").alias("n_obs"), F.count(size).alias("n_sold"),
                F.avg(size).alias("__mu"), F.stddev_pop(size).alias("__sd")))
    adi = F.when(F.col("n_sold") > 0, F.col("n_obs") / F.col("n_sold"))
    cv2 = F.when(F.col("n_sold") > 1, (F.col("__sd") / F.col("__mu")) ** 2).otherwise(F.lit(0.0))
    rare = F.coalesce(adi >= adi_cut, F.lit(True))
    name = (F.when(F.col("n_obs") < MIN_OBSERVED, "new")
             .when(~rare, F.when(cv2 < cv2_cut, "smooth").otherwise("erratic"))
             .otherwise(F.when(cv2 < cv2_cut, "intermittent").otherwise("lumpy")))
    return agg.select("series_id", "n_obs", "n_sold", adi.alias("adi"), cv2.alias("cv2"), name.alias("demand_class"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows a score may use: target known and not censored."""
    return rows.where(F.col("y").isNotNull() & ~F.col("censored"))


def select_routes(cal: DataFrame, scale: DataFrame, candidates: Sequence[str] = ROUTE_CANDIDATES,
                  min_rows: int = MIN_ROUTE_ROWS, young_age: int = YOUNG_AGE) -> DataFrame:
    """(demand_class, route, mase): best model of the intermittent and lumpy classes on the
    calibration block; ties keep the first candidate."""
    rows = usable(cal).where(F.col("demand_class").isin(*ROUTED_CLASSES) & (F.col("age") >= young_age))
    long = unpivot_models(rows, ["series_id", "demand_class", "y"], candidates)
    scored = mase_by(long, scale, ["demand_class", "model"])
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    return (scored.where(F.col("rows") >= min_rows).groupBy("demand_class")
            .agg(F.min_by("model", F.struct("mase", order)).alias("route"), F.min("mase").alias("mase")))


def choose_young_route(cal: DataFrame, candidates: Sequence[str] = YOUNG_CANDIDATES, min_rows: int = MIN_YOUNG_ROWS,
                       young_age: int = YOUNG_AGE, default: str = "c1") -> DataFrame:
    """One row (rows, young_route): lowest-WAPE model on young calibration rows, else ``default``."""
    from demandsense.functions import scores
    young = usable(cal).where(F.col("age") < young_age)
    agg = young.agg(F.count(F.lit(1)).alias("rows"), *[scores.wape("y", m).alias(m) for m in candidates])
    best = F.array_sort(F.array(*[F.struct(F.coalesce(F.col(m), F.lit(float("inf"))).alias("w"), F.lit(i).alias("i"), F.lit(m).alias("m"))
                                  for i, m in enumerate(candidates)]))[0]["m"]
    return agg.select("rows", F.when(F.col("rows") >= min_rows, best).otherwise(F.lit(default)).alias("young_route"))


def apply_routes(rows: DataFrame, routes: DataFrame, young_route: str | Column, models: Sequence[str],
                 default: str = "m2", young_age: int = YOUNG_AGE) -> DataFrame:
    """route, final, p10/p50/p90 and cls_group.

    ``routes`` has at most one row per routed demand class (five classes), so it is broadcast.  Rows not routed to the default
    model get Poisson bands around their forecast.
    """
    young = F.col("age") < young_age
    young_route = F.lit(young_route) if isinstance(young_route, str) else young_route
    route_map = routes.select("demand_class", F.col("route").alias("__class_route"))
    rows = rows.join(F.broadcast(route_map), "demand_class", "left").withColumn(
        "route", F.when(young, young_route).otherwise(F.coalesce("__class_route", F.lit(default))))
    pick = F.lit(None).cast("double")
    for m in models:
        pick = F.when(F.col("route") == m, F.col(m)).otherwise(pick)
    rows = rows.withColumn("final", pick)
    rows = rows.withColumn("__q", F.when(F.col("route") != default, poisson_quantiles(F.col("final"))))
    bands = [F.coalesce(F.col("__q")[i], F.col(f"{default}_{p}")).alias(p) for i, p in enumerate(("p10", "p50", "p90"))]
    return rows.select(*[c for c in rows.columns if c not in ("__q", "__class_route")], *bands,
                       F.when(young, "new").otherwise(F.col("demand_class")).alias("cls_group"))
