"""Boosted regression trees of the log ratio of sales to the usual level, for all series and horizons.

The label is ``log((y + 1) / (level + 1))`` with the level known at the origin, so series of any size share one scale
and a squared loss fits; a forecast turns the ratio back and is corrected by one factor that makes the
forecasts of the training rows add up to their sales.  Trees take a missing value as a value of its own, below all others.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.functions.numeric import finite
from demandsense.operators.features import FAMILIES

TREES, DEPTH, BINS, RATE, SHARE, LEAF = 25, 5, 64, 0.2, 0.8, 20
MISSING = -1e9
FAMILY_OF = {f: fam for fam, fs in FAMILIES.items() for f in fs} | {"level_idx": "item/store"}


def level() -> Column:
    return F.greatest(F.coalesce("mean28", "mean56", "mean7", F.lit(0.0)), F.lit(0.0))


def log_ratio(y: Column) -> Column:
    return F.log((y + 1) / (level() + 1))


def back(ratio: Column) -> Column:
    """The value with this log ratio to the row's level, never negative."""
    return F.greatest(F.exp(ratio) * (level() + 1) - 1, F.lit(0.0))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    named = [F.coalesce(finite(f), F.lit(MISSING)).alias(f"t_{f}") for f in features]
    made = df.select("*", *named)
    return VectorAssembler(inputCols=[f"t_{f}" for f in features], outputCol="__trees").transform(made).drop(*[f"t_{f}" for f in features])


@dataclass
class BoostedModel:
    """Fitted trees, their features in order, and the factor of the forecasts."""

    features: list[str]
    trees: GBTRegressionModel
    factor: float

    def ratios(self, df: DataFrame, out: str) -> DataFrame:
        return self.trees.transform(assembled(df, self.features)).select(*df.columns, F.col("prediction").alias(out))

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        return self.ratios(df, "__ratio").select(*df.columns, (back(F.col("__ratio")) * self.factor).alias(out))

    def save(self, path: str) -> None:
        """The trees and, last, a row of metadata: a folder without it is not a model."""
        self.trees.write().overwrite().save(f"{path}/trees")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.features), self.factor)], "features string, factor double").coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        facts = spark.read.schema("features string, factor double").json(f"{path}/facts").first()
        return BoostedModel(json.loads(facts["features"]), GBTRegressionModel.load(f"{path}/trees"), facts["factor"])

    def importance(self) -> list[tuple[str, str, float]]:
        """(feature, family, share of the gain)."""
        gain = self.trees.featureImportances
        return [(f, FAMILY_OF.get(f, "other"), float(gain[i])) for i, f in enumerate(self.features)]


def fit_boosted(train: DataFrame, features: Sequence[str], target: str = "y_train", trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> BoostedModel:
    """``train`` holds the features, ``mean28`` and its kin, and ``target``; rows without a target are left out."""
    rows = assembled(train.where(F.col(target).isNotNull()), features).withColumn("__label", log_ratio(F.col(target)))
    learner = GBTRegressor(featuresCol="__trees", labelCol="__label", maxIter=trees, maxDepth=depth, maxBins=BINS, stepSize=RATE, subsamplingRate=SHARE,
                           minInstancesPerNode=LEAF, seed=seed, maxMemoryInMB=512)
    model = BoostedModel(list(features), learner.fit(rows.select("__trees", "__label")), 1.0)
    sums = model.predict(train.where(F.col(target).isNotNull()), "__f").agg(F.sum(target).alias("y"), F.sum("__f").alias("f")).first()
    model.factor = float(sums["y"] / sums["f"]) if sums["f"] else 1.0
    return model
