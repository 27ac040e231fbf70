"""Linear quantile regression over all rows: pinball loss by reweighted least squares.

The pinball loss of a residual is at most a parabola that touches it at the last residual, so each round solves weighted
normal equations whose weights are ``1 / (|residual| + EPSILON)`` and never does worse on the smoothed loss.  A round is one
pass over the rows: tasks add up the (features + 1)^2 sums of every quantile, the driver solves them; nothing else
leaves the tasks.  Rounds end when the loss stands still, at the latest after ``ROUNDS``.

The design is standardised and carries an intercept; a column that never varies gets no weight.  Rows with a missing
target are left out, missing features count as the column's mean.
"""
from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.functions.numeric import finite

QUANTILES = (0.1, 0.5, 0.9)
ROUNDS, TOLERANCE, RIDGE = 100, 1e-7, 1e-9
#: Smoothing of the absolute value, as a share of the target's spread; divided by ten when the loss stands still, down to the last.
EPSILON, LAST_EPSILON = 1e-2, 1e-5


@dataclass
class QuantileModel:
    """Weights of the standardised features and the intercept for each quantile."""

    features: list[str]
    quantiles: list[float]
    means: list[float]
    spreads: list[float]
    weights: list[list[float]]      # quantile x (intercept, features...)
    losses: list[float]             # mean pinball loss per quantile on the training rows
    rounds: int

    def columns(self) -> list[Column]:
        """The fitted value of each quantile, as expressions."""
        shaped = [(F.coalesce(finite(f), F.lit(m)) - m) / s if s else None for f, m, s in zip(self.features, self.means, self.spreads)]
        out = []
        for w in self.weights:
            value = F.lit(w[0])
            for x, v in zip(shaped, w[1:]):
                value = value + x * v if x is not None and v else value
            out.append(value)
        return out

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> QuantileModel:
        return QuantileModel(**json.loads(spark.read.schema("model string").json(path).first()["model"]))


def _sums(width: int, quantiles: Sequence[float], weights: np.ndarray, epsilon: float):
    """Per task: X'WX, X'Wy and the pinball loss of every quantile, as one row of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(quantiles)
        a, b, loss = np.zeros((k, width, width)), np.zeros((k, width)), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            y = batch.column(1).to_numpy()
            for i, q in enumerate(quantiles):
                e = y - x @ weights[i]
                loss[i] += np.maximum(q * e, (q - 1) * e).sum()
                w = 1 / (np.abs(e) + epsilon)
                xw = x * w[:, None]
                a[i] += xw.T @ x
                # the parabola of the loss is (e^2 / |e| + (4 q - 2) e) / 4: a weighted square and a shift
                b[i] += xw.T @ y + (2 * q - 1) * x.sum(axis=0)
        flat = np.concatenate([a.ravel(), b.ravel(), loss])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])
    return run


def fit_quantiles(rows: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float] = QUANTILES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> QuantileModel:
    """All quantiles together, from rows with ``features`` and ``target``."""
    features, quantiles = list(features), list(quantiles)
    kept = cut(rows.where(finite(target).isNotNull()).select(*[finite(f).alias(f) for f in features], F.col(target).cast("double").alias("__y")))
    stat = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("y"), F.stddev_pop("__y").alias("s"),
                    *[g(f).alias(f"{p}{i}") for i, f in enumerate(features) for p, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stat["n"]:
        raise ValueError("no rows with a target to fit quantiles on")
    means = [float(stat[f"m{i}"] or 0.0) for i in range(len(features))]
    spreads = [float(stat[f"s{i}"] or 0.0) for i in range(len(features))]
    spreads = [s if s > 1e-12 * max(1.0, abs(m)) else 0.0 for s, m in zip(spreads, means)]
    on = [i for i, s in enumerate(spreads) if s]
    width, unit = len(on) + 1, float(stat["s"] or 0.0) or 1.0
    design = cut(kept.select(F.array(F.lit(1.0), *[(F.coalesce(F.col(features[i]), F.lit(means[i])) - means[i]) / spreads[i] for i in on]).alias("x"), (F.col("__y") / unit).alias("y")))
    weights = np.zeros((len(quantiles), width))
    weights[:, 0] = float(stat["y"]) / unit
    epsilon, last, best, done = EPSILON, np.inf, (np.inf, weights, np.zeros(len(quantiles))), 0
    for done in range(1, rounds + 1):
        got = design.mapInArrow(_sums(width, quantiles, weights, epsilon), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(got.num_rows)
        flat[got.column("at").to_numpy()] = got.column("v").to_numpy()
        a, b, loss = np.split(flat, [len(quantiles) * width * width, len(flat) - len(quantiles)])
        loss = loss / stat["n"]
        if loss.sum() < best[0]:
            best = (float(loss.sum()), weights, loss)
        if last - loss.sum() <= tolerance * loss.sum():
            if epsilon <= LAST_EPSILON:
                break
            epsilon /= 10
        last = float(loss.sum())
        a, b = a.reshape(len(quantiles), width, width), b.reshape(len(quantiles), width)
        weights = np.stack([np.linalg.solve(m + RIDGE * np.trace(m) / width * np.eye(width), v) for m, v in zip(a, b)])
    _, weights, loss = best
    full = np.zeros((len(quantiles), len(features) + 1))
    full[:, [0, *[i + 1 for i in on]]] = weights * unit
    return QuantileModel(features, quantiles, means, spreads, full.tolist(), (loss * unit).tolist(), done)
