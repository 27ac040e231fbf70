"""Drift, rolling accuracy, freshness and latency summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions import scores
from demandsense.functions.noise import hash_uniform
from demandsense.functions.numeric import finite
from demandsense.operators.features import FAMILIES, MULTISOURCE
from demandsense.operators.order_stats import group_quantiles

# Alert levels, bins, share floor.
PSI_ALERT, BIAS_ALERT, PSI_BINS, SHARE_FLOOR = 0.2, 0.15, 10, 1e-4
# Codes, the calendar and a series' age move on a schedule; everything else can drift.
DRIFT_FEATURES = [f for f in MULTISOURCE if not (f in FAMILIES["calendar"] + FAMILIES["events"] + ["age"] or f in FAMILIES["item/store"] and f.endswith("_idx"))]
LATENCY = (0.5, 0.95, 0.99)


def sample_rows(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Reproducible sample: a row is in or out by the hash of its key."""
    return df.where(hash_uniform(F.lit(seed), *[F.col(k) for k in keys]) < fraction)


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(f).cast("double") for f in features])
            .unpivot([], list(features), "feature", "x").withColumn("x", finite("x")).where("x IS NOT NULL"))


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = PSI_BINS, alert: float = PSI_ALERT) -> DataFrame:
    """(feature, psi, alert): population stability index for all features in one job.

    Edges are the distinct exact quantiles of the reference with open ends; fewer than three
    edges give 0, an empty side gives NULL."""
    ref, cur = _long(reference, features), _long(current, features)
    q = group_quantiles(ref, ["feature"], "x", [i / bins for i in range(bins + 1)])
    edges = q.groupBy("feature").agg(F.array_sort(F.collect_set("q")).alias("edges"))       # bins + 1 values
    both = ref.withColumn("side", F.lit(0)).unionByName(cur.withColumn("side", F.lit(1)))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = (both.join(F.broadcast(edges), "feature")                  # a row for each feature name
              .withColumn("bin", F.aggregate(inner, F.lit(0), lambda a, e: a + (F.col("x") >= e).cast("int"))))
    counts = binned.groupBy("feature", "bin").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    w = Window.partitionBy("feature")
    share = counts.select("feature", "bin", (F.col("r") / F.sum("r").over(w)).alias("r"),
                          F.try_divide("c", F.sum("c").over(w)).alias("c"))
    # bins without any row still count with the floor share on both sides, which adds 0
    r, c = F.greatest("r", F.lit(SHARE_FLOOR)), F.greatest("c", F.lit(SHARE_FLOOR))
    total = share.groupBy("feature").agg(F.sum(F.when(F.col("c").isNotNull(), (c - r) * F.log(c / r))).alias("raw"))
    out = edges.join(total, "feature").select(
        "feature", F.when(F.col("raw").isNull(), None).when(F.size("edges") < 3, 0.0).otherwise(F.col("raw")).alias("psi"))
    names = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(out, "feature", "left").select("feature", "psi", F.coalesce(F.col("psi") > alert, F.lit(False)).alias("alert"))


def weekly_accuracy(rows: DataFrame, by: str = "origin_date") -> DataFrame:
    return rows.groupBy(by).agg(scores.wape("y", "final").alias("wape_final"), scores.wape("y", "b0").alias("wape_b0"),
                                scores.bias("y", "final").alias("bias_final"))


def store_bias(rows: DataFrame, by: Sequence[str] = ("store_id", "origin"), limit: float = BIAS_ALERT) -> DataFrame:
    out = rows.groupBy(*by).agg(scores.bias("y", "final").alias("bias"))
    return out.withColumn("alert", F.coalesce(F.abs("bias") > limit, F.lit(False)))


def detection_lag(bias: DataFrame, limit: float = BIAS_ALERT, entity: str = "store_id") -> DataFrame:
    """(entity, weeks, detected_in_week): week number of the first bias above ``limit``;
    an entity has one row per test origin."""
    w = Window.partitionBy(entity).orderBy("origin")
    weeks = bias.withColumn("week", F.row_number().over(w))
    return weeks.groupBy(entity).agg(F.max("week").alias("weeks"), F.min(F.when(F.col("bias") > limit, F.col("week"))).alias("detected_in_week"))


def freshness(sources: dict[str, tuple[DataFrame, str | Column]]) -> DataFrame:
    """(source, last_date) from one column of each source."""
    out = None
    for name, (df, c) in sources.items():
        row = df.agg(F.max(c).alias("last_date")).select(F.lit(name).alias("source"), "last_date")
        out = row if out is None else out.unionByName(row)
    return out


def latency_summary(log: DataFrame, ms: str = "ms", ok: Column | None = None) -> DataFrame:
    """One row: requests, p50/p95/p99/max and error count of a request log."""
    q = group_quantiles(log, [], ms, LATENCY)
    pct = q.agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(f"p{int(p * 100)}") for p in LATENCY])
    good = F.lit(True) if ok is None else ok
    rest = log.agg(F.count(F.lit(1)).alias("requests"), F.max(ms).alias("max"), F.count_if(~good).alias("errors"))
    return rest.join(F.broadcast(pct)).select("requests", "p50", "p95", "p99", "max", "errors")      # one row each
