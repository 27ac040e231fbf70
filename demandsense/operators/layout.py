"""Rolling origins of a backtest, counted back from the last observed day.

From the end: the production origin, then weekly test, calibration and training origins.  Between two
blocks lies the least whole number of steps that exceeds the horizon, so their target days do not meet.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default backtest shape.
HORIZON, STEP = 14, 7
N_TEST, N_CAL, MAX_TRAIN, MIN_HISTORY = 8, 8, 78, 60


@dataclass(frozen=True)
class Layout:
    train: list[int]
    cal: list[int]
    test: list[int]
    production: int
    horizon: int

    @property
    def train_end(self) -> int:
        """Last target day of the training block."""
        return self.train[-1] + self.horizon

    def block(self, name: str) -> list[int]:
        return [self.production] if name == "production" else getattr(self, name)


def origin_layout(n_obs: int, horizon: int = HORIZON, step: int = STEP, n_test: int = N_TEST, n_cal: int = N_CAL,
                  max_train: int = MAX_TRAIN, min_history: int = MIN_HISTORY) -> Layout:
    gap = step * (horizon // step + 1)          # smallest multiple of step above horizon
    first_test = n_obs - 1 - horizon - step * (n_test - 1)
    first_cal = first_test - gap - step * (n_cal - 1)
    last_train = first_cal - gap
    n_train = min(max_train, (last_train - min_history) // step + 1)
    if n_train < 1:
        raise ValueError(f"{n_obs} observed days leave no training origin")
    return Layout(train=[last_train - step * i for i in reversed(range(n_train))],
                  cal=[first_cal + step * i for i in range(n_cal)],
                  test=[first_test + step * i for i in range(n_test)],
                  production=n_obs - 1, horizon=horizon)


def layout_frame(spark: SparkSession, layout: Layout) -> DataFrame:
    rows = [(b, o) for b in ("train", "cal", "test", "production") for o in layout.block(b)]
    return spark.createDataFrame(rows, "block string, origin int")


def block_windows(origins: DataFrame, horizon: int) -> DataFrame:
    """First and last target day of each block."""
    return origins.groupBy("block").agg((F.min("origin") + 1).alias("first_day"), (F.max("origin") + horizon).alias("last_day"),
                                        F.count(F.lit(1)).alias("origins"))


def block_of(layout: Layout, origin: Column) -> Column:
    """Block name of an origin column (origins of a block are few and known)."""
    out = F.lit(None).cast("string")
    for name in ("production", "test", "cal", "train"):
        out = F.when(origin.isin(layout.block(name)), F.lit(name)).otherwise(out)
    return out
