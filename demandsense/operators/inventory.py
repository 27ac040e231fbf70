"""Order-up-to levels, suggested orders and indicators over a recorded stock ledger."""
from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Protection period, policy names and cost parameters.
LEAD_DAYS, REVIEW_DAYS = 3, 1
SERVICE_TARGET, BUFFER = 0.95, 0.20
HOLDING_RATE, MARGIN, OVERSTOCK_DAYS = 0.0007, 0.25, 21
POLICIES = ("P0_manual", "P1_point_ml", "P2_uncertainty")
BAND_SDS = NormalDist().inv_cdf(0.9) - NormalDist().inv_cdf(0.1)


def service_z(target: float = SERVICE_TARGET) -> float:
    return NormalDist().inv_cdf(target)


def order_up_to(rows: DataFrame, resid_sd: DataFrame, first_h: int = 1, n_days: int = LEAD_DAYS + REVIEW_DAYS,
                z: float | None = None, buffer: float = BUFFER) -> DataFrame:
    """(series_id, origin, one level per policy) over protection days first_h.. of an origin."""
    z = service_z() if z is None else z
    win = rows.where(F.col("h").between(first_h, first_h + n_days - 1))
    sd_day = F.greatest(F.col("p90c") - F.col("p10c"), F.lit(0.0)) / BAND_SDS
    agg = win.groupBy("series_id", "origin").agg(F.sum("b1").alias("planned"), F.sum("final").alias("mu"), F.sum(sd_day**2).alias("var"))
    agg = agg.join(resid_sd, "series_id")

    def up(x):
        return F.ceil(F.round(x, 9)).cast("double")

    return agg.select("series_id", "origin", up((1 + buffer) * F.col("planned")).alias(POLICIES[0]),
                      up(F.col("mu") + z * F.col("resid_sd") * float(n_days) ** 0.5).alias(POLICIES[1]),
                      up(F.col("mu") + z * F.sqrt("var")).alias(POLICIES[2]))


def production_orders(rows: DataFrame, series: DataFrame, drivers: Sequence[str] = (), n_days: int = LEAD_DAYS + REVIEW_DAYS,
                      z: float | None = None) -> DataFrame:
    """Suggested order per series from the production origin.  ``series``: series_id, on_hand
    (and optionally on_order) plus keys; mean drivers ride along."""
    z = service_z() if z is None else z
    sd_day = F.greatest(F.col("p90c") - F.col("p10c"), F.lit(0.0)) / BAND_SDS
    agg = rows.where(F.col("h") <= n_days).groupBy("series_id", "origin_date").agg(
        F.sum("final").alias("mu"), F.sum(sd_day**2).alias("var"), F.sum("p10c").alias("p10"), F.sum("p90c").alias("p90"),
        *[F.avg(d).alias(d) for d in drivers])
    stock = F.col("on_hand") + (F.coalesce("on_order", F.lit(0.0)) if "on_order" in series.columns else F.lit(0.0))
    out = agg.withColumn("order_up_to", F.ceil(F.round(F.col("mu") + z * F.sqrt("var"), 9)).cast("double")).join(series, "series_id")
    return (out.withColumn("suggested_qty", F.greatest(F.col("order_up_to") - stock, F.lit(0.0)).cast("bigint"))
               .withColumn("order_date", F.date_format("origin_date", "yyyy-MM-dd"))
               .withColumn("policy", F.lit(POLICIES[2])).drop("origin_date"))


def on_hand_snapshot(sales: DataFrame, series: DataFrame, last_day: int) -> DataFrame:
    """(series_id, on_hand) at the last day, 0 without a row."""
    last = sales.where(F.col("day_idx") == last_day).select("series_id", F.col("on_hand_close").alias("__oh"))
    return series.select("series_id").join(last, "series_id", "left").select("series_id", F.coalesce("__oh", F.lit(0.0)).alias("on_hand"))


def ledger_kpis(ledger: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Indicators per policy from a stock ledger with series_id, day_idx, demand, on_hand, sold,
    lost, ordered, price.  Two levels: per series first, then per policy."""
    own = Window.partitionBy(*by, "series_id")
    rated = ledger.withColumn("__rate", F.greatest(F.avg("demand").over(own), F.lit(1e-6)))       # same exchange as the sums below
    day = rated.groupBy(*by, "series_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("sold").alias("sold"), F.sum("lost").alias("lost"), F.sum("on_hand").alias("oh"),
        F.sum("ordered").alias("ordered"), F.count_if(F.col("lost") > 0).alias("out"), F.first("__rate").alias("rate"),
        F.sum(F.col("on_hand") * F.col("price")).alias("oh_value"), F.sum(F.col("lost") * F.col("price")).alias("lost_value"),
        F.sum(F.greatest(F.col("on_hand") - OVERSTOCK_DAYS * F.col("__rate"), F.lit(0.0))).alias("over"),
        F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"))
    a = day.groupBy(*by).agg(
        F.count(F.lit(1)).alias("series"), F.sum("days").alias("series_days"), F.sum("sold").alias("sold"), F.sum("lost").alias("lost"),
        F.sum("oh").alias("oh"), F.sum("ordered").alias("ordered"), F.sum("out").alias("out"), F.sum("rate").alias("rate"),
        F.sum("oh_value").alias("oh_value"), F.sum("lost_value").alias("lost_value"), F.sum("over").alias("over"),
        (F.max("last_day") - F.min("first_day") + 1).alias("n_days"))
    per_day = lambda c: F.col(c) / F.col("n_days")
    return a.select(
        *by, (F.col("sold") / F.greatest(F.col("sold") + F.col("lost"), F.lit(1.0))).alias("fill_rate"),
        (F.col("out") / F.col("series_days")).alias("stockout_day_rate"), (F.col("out") / F.col("series")).alias("stockout_days_per_series"),
        per_day("oh").alias("avg_on_hand_units"), (per_day("oh") / F.col("rate")).alias("avg_days_of_cover"),
        per_day("over").alias("overstock_units_per_day"), per_day("lost").alias("lost_units_per_day"),
        per_day("ordered").alias("units_ordered_per_day"), (per_day("oh_value") * HOLDING_RATE).alias("holding_cost_per_day"),
        (per_day("lost_value") * MARGIN).alias("lost_margin_per_day"),
        (per_day("oh_value") * HOLDING_RATE + per_day("lost_value") * MARGIN).alias("total_cost_per_day"))


def ledger_trace(ledger: DataFrame, by: Sequence[str] = ("policy",), paths: int = 1) -> DataFrame:
    """Units on hand, lost and demanded per policy and day (mean over recorded paths)."""
    return ledger.groupBy(*by, "day_idx").agg(
        *[(F.sum(c) / paths).alias(c) for c in ("on_hand", "lost", "demand")])


def cover_at_fill(frontier: DataFrame, target: float) -> DataFrame:
    """(policy, cover): days of cover at a target fill rate, linear between the neighbouring
    frontier points; NULL when the frontier does not reach the target."""
    w = Window.partitionBy("policy").orderBy("fill_rate", "days_of_cover")
    seg = (frontier.withColumn("x1", F.lead("fill_rate").over(w)).withColumn("y1", F.lead("days_of_cover").over(w)))
    x0, y0, x1, y1 = (F.col(c) for c in ("fill_rate", "days_of_cover", "x1", "y1"))
    at = F.when((x0 <= target) & (target < x1), y0 + (y1 - y0) * (target - x0) / (x1 - x0)) \
          .when(x1.isNull() & (x0 == target), y0)
    return seg.groupBy("policy").agg(F.max(at).alias("cover"))


def compare_policies(kpis: DataFrame, base: str = POLICIES[0], other: str = POLICIES[2]) -> DataFrame:
    """One row: stockout reduction and inventory and cost change of ``other`` against ``base``."""
    def pick(policy, c):
        return F.max(F.when(F.col("policy") == policy, F.col(c)))

    def change(c):
        return pick(other, c) / F.greatest(pick(base, c), F.lit(1e-9))

    return kpis.agg((1 - change("stockout_day_rate")).alias("stockout_reduction"),
                    (change("avg_on_hand_units") - 1).alias("inventory_change"),
                    (change("total_cost_per_day") - 1).alias("cost_change"))


def established_series(rows: DataFrame, first_origin: int, min_age: int = 28) -> DataFrame:
    return (rows.where(F.col("origin") == first_origin).groupBy("series_id").agg(F.min("age").alias("age"))
            .where(F.col("age") >= min_age).select("series_id"))


def latest_origin(days: DataFrame, origins: Sequence[int]) -> DataFrame:
    """Add the latest forecast origin on or before each day (origins are few and known)."""
    at = F.array_max(F.filter(F.array(*[F.lit(int(o)) for o in origins]), lambda o: o <= F.col("day_idx")))
    return days.withColumn("origin", at)
