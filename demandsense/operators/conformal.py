"""Conformalized quantile bands: widen or tighten raw bands by a calibrated amount."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.operators.order_stats import order_statistics

# Miscoverage, smallest group with its own adjustment, bucket names.
ALPHA, MIN_GROUP = 0.2, 50
BUCKETS = ("h1-3", "h4-7", "h8-14")


def horizon_bucket(h: Column) -> Column:
    return F.when(h <= 3, BUCKETS[0]).when(h <= 7, BUCKETS[1]).otherwise(BUCKETS[2])


def conformity_score(y: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - y, y - hi)


def finite_sample_rank(n: Column, alpha: float) -> Column:
    """1-based rank of the ceil((n+1)(1-alpha))/n quantile, taking the higher neighbour."""
    up = F.ceil(F.round((n + 1) * (1 - alpha), 9))
    level = F.least(F.lit(1.0), up / n)
    return F.ceil(F.round(level * (n - 1), 9)).cast("bigint") + 1


def _adjustment(scored: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    def wanted(n):
        return F.array(F.struct(F.lit(0).alias("tag"), finite_sample_rank(n, alpha).alias("rank")))
    return order_statistics(scored, by, "score", wanted).drop("tag").withColumnRenamed("stat", "adjustment")


def fit(rows: DataFrame, alpha: float = ALPHA, min_group: int = MIN_GROUP, lo: str = "p10", hi: str = "p90") -> DataFrame:
    """(bucket, cls_group, n, adjustment) per group plus a global row (both keys NULL);
    groups under ``min_group`` rows carry the global adjustment."""
    scored = cut(rows.select(horizon_bucket(F.col("h")).alias("bucket"), "cls_group",
                             conformity_score(F.col("y"), F.col(lo), F.col(hi)).alias("score")))
    overall = _adjustment(scored, [], alpha)
    groups = _adjustment(scored, ["bucket", "cls_group"], alpha)
    one = overall.select(F.col("adjustment").alias("__global"))
    groups = groups.join(F.broadcast(one)).select(            # one row
        "bucket", "cls_group", "n", F.when(F.col("n") >= min_group, F.col("adjustment")).otherwise(F.col("__global")).alias("adjustment"))
    return groups.unionByName(overall.select(F.lit(None).cast("string").alias("bucket"),
                                             F.lit(None).cast("string").alias("cls_group"), "n", "adjustment"))


def apply(rows: DataFrame, fitted: DataFrame, lo: str = "p10", hi: str = "p90") -> DataFrame:
    """p10c / p90c: bands moved by their group's adjustment (global when unknown), >= 0."""
    groups = fitted.where("bucket IS NOT NULL").select("bucket", "cls_group", F.col("adjustment").alias("__own"))
    overall = fitted.where("bucket IS NULL").agg(F.max("adjustment").alias("__all"))
    move = F.coalesce("__own", "__all", F.lit(0.0))
    out = (rows.withColumn("bucket", horizon_bucket(F.col("h"))).join(F.broadcast(groups), ["bucket", "cls_group"], "left")      # horizon buckets x classes
               .join(F.broadcast(overall)))                   # one row
    return out.select(*rows.columns, "bucket", F.greatest(F.col(lo) - move, F.lit(0.0)).alias("p10c"),
                      F.greatest(F.col(hi) + move, F.lit(0.0)).alias("p90c"))
