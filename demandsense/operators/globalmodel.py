"""Global models over all series and horizons with Spark ML, and their explanations.

A Tweedie regression with a log link is one distributed fit over all feature rows.
Because the link is a log, a feature's share of a forecast is exactly coefficient times
(value - mean), so drivers need no approximation.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.operators.conformal import horizon_bucket
from demandsense.operators.features import FAMILIES
from demandsense.operators.order_stats import group_quantiles

# Variance power of the point model, reported quantiles.
VARIANCE_POWER = 1.2
QUANTILES = (0.1, 0.5, 0.9)
VOLUME = {"last_obs", "mean7", "mean28", "mean56", "std28", "sdw_mean4"}      # enter as log1p
# enter one-hot; the declared widths bound the design, codes beyond them share entries
CODES = {"cat_idx": 64, "store_idx": 128, "region_idx": 32, "level_idx": 8, "event_id": 32, "dow": 7, "month": 12, "woy": 53}
COUNTED_FROM_ONE = {"month", "woy"}
FAMILY_OF = {f: fam for fam, fs in FAMILIES.items() for f in fs} | {"level_idx": "item/store"}


def design(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """x_<feature> columns: volumes on the log scale, codes by position, missing values at 0; na_<feature> flags missing history."""
    out = [F.col(f).isNull().cast("double").alias(f"na_{f}") for f in features if f in FAMILIES["history"]]
    for f in features:
        if f in CODES:
            code = F.col(f) - 1 if f in COUNTED_FROM_ONE else F.col(f)
            out.append(F.pmod(F.coalesce(code, F.lit(0)).cast("int"), F.lit(CODES[f])).alias(f"x_{f}"))
        elif f in VOLUME:
            out.append(F.log1p(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"x_{f}"))
        else:
            out.append(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x_{f}"))
    return df.select("*", *out)


@dataclass
class GlobalModel:
    """Fitted pipeline with the mean of its design vector."""

    features: list[str]
    stages: PipelineModel
    names: list[str]              # design entry -> feature
    coefficients: list[float]
    intercept: float
    means: list[float]

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.stages.transform(design(df, self.features))
        return scored.select(*df.columns, F.greatest("prediction", F.lit(0.0)).alias(out))

    def design_vector(self, df: DataFrame) -> DataFrame:
        scored = self.stages.transform(design(df, self.features))
        return scored.select(*df.columns, vector_to_array("design").alias("design"))


def save_model(model: GlobalModel, path: str) -> None:
    """The fitted pipeline, then its names and numbers as one row."""
    model.stages.write().overwrite().save(f"{path}/stages")
    facts = {k: getattr(model, k) for k in ("features", "names", "coefficients", "intercept", "means")}
    SparkSession.active().createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> GlobalModel:
    facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])
    return GlobalModel(stages=PipelineModel.load(f"{path}/stages"), **facts)


def _fit(df: DataFrame, features: Sequence[str], regression, weight: str | None = None) -> GlobalModel:
    # a column that never varies in training carries nothing and makes the fit singular
    columns = [f"x_{f}" for f in features] + [f"na_{f}" for f in features if f in FAMILIES["history"]]
    varies = design(df, features).agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    codes = [f for f in features if f in CODES and varies[f"x_{f}"]]
    entries = [c for c in columns if varies[c] and c.removeprefix("x_") not in CODES]
    plain = [c.split("_", 1)[1] for c in entries]
    encoder = OneHotEncoder(inputCols=[f"x_{f}" for f in codes], outputCols=[f"o_{f}" for f in codes], handleInvalid="keep")
    assembler = VectorAssembler(inputCols=entries + [f"o_{f}" for f in codes], outputCol="design")
    shaped_in = design(df, features)
    model = Pipeline(stages=[encoder, assembler, regression.setFeaturesCol("design")]).fit(shaped_in)
    sizes = model.stages[0].categorySizes
    names = plain + [f for f, n in zip(codes, sizes) for _ in range(n)]
    shaped = model.stages[1].transform(model.stages[0].transform(shaped_in))
    means = shaped.agg(Summarizer.mean(F.col("design")).alias("m")).first()["m"]
    reg = model.stages[-1]
    return GlobalModel(list(features), model, names, [float(c) for c in reg.coefficients], float(reg.intercept), [float(m) for m in means])


def fit_point_model(train: DataFrame, features: Sequence[str], target: str = "y_train", max_iter: int = 25) -> GlobalModel:
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=VARIANCE_POWER, linkPower=0.0, labelCol=target,
                                      maxIter=max_iter, regParam=1e-3)
    return _fit(train, features, glm)


def fit_aggregate_model(train: DataFrame, features: Sequence[str], target: str = "target_ratio") -> GlobalModel:
    """Squared-loss model of the ratio target for aggregate nodes."""
    return _fit(train.where(F.col(target).isNotNull()), features, LinearRegression(labelCol=target, regParam=1e-3))


def aggregate_forecast(model: GlobalModel, rows: DataFrame, out: str = "base") -> DataFrame:
    """Predicted ratio times the scale of the row, never negative."""
    return model.predict(rows, "__r").withColumn(out, F.col("__r") * F.col("scale")).drop("__r")


def residual_ratio_quantiles(train: DataFrame, point: str = "m2", target: str = "y_train", probs: Sequence[float] = QUANTILES) -> DataFrame:
    """(demand_class, bucket, q10, q50, q90) of target / forecast on training rows."""
    rows = train.select("demand_class", horizon_bucket(F.col("h")).alias("bucket"),
                        (F.col(target) / F.greatest(F.col(point), F.lit(1e-6))).alias("ratio"))
    q = group_quantiles(rows, ["demand_class", "bucket"], "ratio", probs)
    return q.groupBy("demand_class", "bucket").agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(f"r{round(p * 100)}") for p in probs])


def with_quantile_heads(rows: DataFrame, ratios: DataFrame, point: str = "m2") -> DataFrame:
    """m2_p10/p50/p90: forecast times the ratio quantiles, sorted so they never cross, >= 0."""
    joined = rows.withColumn("bucket", horizon_bucket(F.col("h"))).join(F.broadcast(ratios), ["demand_class", "bucket"], "left")      # classes x buckets rows
    q = F.array_sort(F.array(*[F.greatest(F.col(point) * F.coalesce(f"r{p}", F.lit(1.0)), F.lit(0.0)) for p in (10, 50, 90)]))
    return joined.select(*rows.columns, *[q[i].alias(f"{point}_p{p}") for i, p in enumerate((10, 50, 90))])


def _contribution(model: GlobalModel, indices: Sequence[int]) -> Column:
    out = F.lit(0.0)
    for i in indices:
        out = out + model.coefficients[i] * (F.get("design", F.lit(i)) - model.means[i])
    return out


def driver_families(model: GlobalModel, rows: DataFrame) -> DataFrame:
    """drv_<family> log contributions per row plus drv_baseline; they sum to the log forecast."""
    vec = model.design_vector(rows)
    by = {}
    for i, f in enumerate(model.names):
        by.setdefault(FAMILY_OF.get(f, "other"), []).append(i)
    base = model.intercept + sum(c * m for c, m in zip(model.coefficients, model.means))
    return vec.select(*rows.columns, *[_contribution(model, ix).alias(f"drv_{fam.replace('/', '_')}") for fam, ix in sorted(by.items())],
                      F.lit(base).alias("drv_baseline"))


def mean_abs_drivers(drivers: DataFrame) -> DataFrame:
    """(family, mean_abs) over a set of explained rows."""
    cols = [c for c in drivers.columns if c.startswith("drv_") and c != "drv_baseline"]
    return (drivers.select(cols).unpivot([], cols, "family", "x").groupBy("family").agg(F.avg(F.abs("x")).alias("mean_abs"))
            .withColumn("family", F.replace("family", F.lit("drv_"), F.lit(""))))


def feature_importance(model: GlobalModel, rows: DataFrame) -> DataFrame:
    """(feature, family, gain): share of mean |contribution| per feature."""
    vec = model.design_vector(rows)
    by = {}
    for i, f in enumerate(model.names):
        by.setdefault(f, []).append(i)
    agg = vec.agg(*[F.avg(F.abs(_contribution(model, ix))).alias(f) for f, ix in by.items()]).unpivot([], list(by), "feature", "m")
    total = agg.agg(F.sum("m").alias("t"))
    fam = F.create_map(*[x for f in by for x in (F.lit(f), F.lit(FAMILY_OF.get(f, "other")))])
    return agg.join(F.broadcast(total)).select("feature", fam[F.col("feature")].alias("family"), F.try_divide("m", "t").alias("gain"))   # one row


def importance_by_family(importance: DataFrame) -> DataFrame:
    return importance.groupBy("family").agg(F.sum("gain").alias("gain"))


def partial_dependence(model: GlobalModel, rows: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """(value, effect): mean log forecast with ``feature`` set to each grid value, relative to
    the first; the grid is a short literal list exploded on each row."""
    first = float(grid[0])
    grown = rows.withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    pred = model.predict(grown, "__p").groupBy(F.col(feature).alias("value")).agg(F.avg(F.log(F.greatest("__p", F.lit(1e-6)))).alias("m"))
    base = pred.where(F.col("value") == first).select(F.col("m").alias("m0"))
    return pred.join(F.broadcast(base)).select("value", (F.col("m") - F.col("m0")).alias("effect"))          # one row
