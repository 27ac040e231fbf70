"""Boosted trees, quantile heads and the trained backtest: known answers, round trips, tables by block."""
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandsense.operators import boosted, quantile_fit
from demandsense.plans import trained
from demandsense.sources import feeds
from demandsense.sources.star import Star


def frame(spark, **columns):
    return spark.createDataFrame(pa.table(columns)).repartition(3)


# ------------------------------------------------------------------ quantile regression
def loss(e, q):
    return np.maximum(q * e, (q - 1) * e).mean()


def fitted(model, x):
    shaped = np.column_stack([np.ones(len(x))] + [(np.where(np.isnan(c), m, c) - m) / s if s else np.zeros(len(x)) for c, m, s in zip(x.T, model.means, model.spreads)])
    return shaped @ np.array(model.weights).T


def test_quantiles_of_a_line_with_growing_spread(spark):
    rng = np.random.default_rng(5)
    n = 6_000
    a, b = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    y = 2 + 3 * a - b + (1 + 0.5 * b) * rng.exponential(size=n)
    model = quantile_fit.fit_quantiles(frame(spark, a=a, b=b, same=np.ones(n), y=y), ["a", "b", "same"], "y")
    x = np.column_stack([a, b, np.ones(n)])
    got = fitted(model, x)
    assert model.spreads[2] == 0 and all(w[3] == 0 for w in model.weights)
    for i, q in enumerate(model.quantiles):
        true = 2 + 3 * a - b - (1 + 0.5 * b) * np.log(1 - q)
        assert np.abs(got[:, i] - true).mean() < 0.08
        assert (y <= got[:, i]).mean() == pytest.approx(q, abs=0.01)
        # no nearby line does better
        for _ in range(50):
            step = rng.normal(size=3) * rng.choice([1e-3, 1e-2, 1e-1])
            other = got[:, i] + step[0] + step[1] * a + step[2] * b
            assert loss(y - got[:, i], q) <= loss(y - other, q) * (1 + 1e-4)
    columns = frame(spark, a=a[:50], b=b[:50], same=np.ones(50)).select("a", "b", "same", *[c.alias(f"f{i}") for i, c in enumerate(model.columns())]).collect()
    for r in columns:
        assert [r.f0, r.f1, r.f2] == pytest.approx(fitted(model, np.array([[r.a, r.b, r.same]]))[0].tolist())


def test_quantiles_without_features_are_the_sample_quantiles(spark):
    y = np.random.default_rng(2).lognormal(size=2_001)
    model = quantile_fit.fit_quantiles(frame(spark, y=y, c=np.zeros(len(y))), ["c"], "y")
    for w, q in zip(model.weights, model.quantiles):
        assert w[0] == pytest.approx(np.quantile(y, q), rel=0.02)
        assert loss(y - w[0], q) <= loss(y - np.quantile(y, q), q) * (1 + 1e-5)


def test_quantiles_of_missing_values_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (float("nan"), 3.0), (2.0, None), (3.0, float("nan")), (0.0, 2.0)], "a double, y double")
    model = quantile_fit.fit_quantiles(rows, ["a"], "y")
    assert all(np.isfinite(model.weights).ravel()) and model.means == [0.5]
    model.save(str(tmp_path / "q"))
    assert quantile_fit.QuantileModel.load(spark, str(tmp_path / "q")) == model
    same = quantile_fit.fit_quantiles(spark.createDataFrame([(1.0, 4.0)] * 20, "a double, y double"), ["a"], "y")
    assert [w[0] for w in same.weights] == pytest.approx([4.0] * 3, abs=1e-3)
    with pytest.raises(ValueError):
        quantile_fit.fit_quantiles(rows.limit(0), ["a"], "y")


# ------------------------------------------------------------------ boosted trees
def test_boosted_model_learns_what_a_line_cannot(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 6_000
    base, dow, promo = rng.uniform(2, 60, n), rng.integers(0, 7, n).astype(float), rng.integers(0, 2, n).astype(float)
    true = base * np.where((dow >= 5) == (promo > 0), 2.0, 0.5)  # an interaction
    y = rng.poisson(true).astype(float)
    gap = np.where(rng.random(n) < 0.2, np.nan, 1.0)
    rows = frame(spark, mean28=base, mean56=base, mean7=base, dow=dow, disc=promo, temp_fc=gap, y_train=y, id=np.arange(n))
    held = F.col("id") % 4 == 0
    model = boosted.fit_boosted(rows.where(~held), ["mean28", "dow", "disc", "temp_fc"])
    got = model.predict(rows, "f").where(held).toPandas()
    want = true[got["id"]]
    assert np.abs(got["f"] - want).sum() / want.sum() < 0.1 and (got["f"] >= 0).all()
    train = model.predict(rows.where(~held), "f").agg(F.sum("f"), F.sum("y_train")).first()
    assert train[0] == pytest.approx(train[1], rel=1e-9)
    share = {f: g for f, _, g in model.importance()}
    assert share["dow"] + share["disc"] > 0.9 and sum(share.values()) == pytest.approx(1)
    model.save(str(tmp_path / "m"))
    again = boosted.BoostedModel.load(spark, str(tmp_path / "m"))
    assert again.features == model.features and again.factor == model.factor
    pairs = again.predict(model.predict(rows, "f"), "g")
    assert pairs.where("f <> g").count() == 0


def test_ratio_and_back(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (7.0, None), (3.0, 0.0)], "y double, mean28 double").withColumns({"mean56": F.lit(None).cast("double"), "mean7": F.lit(None).cast("double")})
    for r in rows.select("y", boosted.back(boosted.log_ratio(F.col("y"))).alias("b")).collect():
        assert r.b == pytest.approx(r.y, abs=1e-12)


# ------------------------------------------------------------------ the backtest
@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    star = Star(spark, "/root/testdata/sf0.001")
    inp, lay = star.inputs()
    old, boosted.TREES = boosted.TREES, 3
    original = boosted.fit_boosted.__defaults__
    boosted.fit_boosted.__defaults__ = ("y_train", 3, 3, 7)
    yield trained.run(spark, inp, lay, str(tmp_path_factory.mktemp("backtest")))
    boosted.TREES, boosted.fit_boosted.__defaults__ = old, original


def test_backtest_is_made_once(spark, made, monkeypatch):
    monkeypatch.setattr(trained, "train", lambda *_: pytest.fail("trained again"))
    again = trained.run(spark, made.inp, made.lay, made.folder)
    rows = again.forecasts(spark)
    assert {r.block for r in rows.select("block").distinct().collect()} == {"cal", "test"}
    assert rows.where("q10 > q50 OR q50 > q90 OR q10 < 0 OR r10 > r50 OR r50 > r90 OR m1 < 0 OR m2 < 0 OR t2 < 0 OR m2 IS NULL OR q90 IS NULL").count() == 0
    assert rows.groupBy("series_id", "origin", "h").count().where("count > 1").count() == 0
    plan = again.forecasts(spark, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan or "PartitionFilters: [isnotnull(block" in plan


def test_a_block_is_made_again_without_touching_the_others(spark, made):
    def files(block):
        folder = f"{made.folder}/forecasts/block={block}"
        return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    before = {b: files(b) for b in ("cal", "test")}
    total = made.forecasts(spark, "test").agg(F.sum("m2"), F.sum("q90"), F.count("*")).first()
    feeds.write_blocks(trained.forecast_block(spark, made.inp, made.lay, made.folder, ["test"]), f"{made.folder}/forecasts")
    assert files("cal") == before["cal"] and not set(files("test")) & set(before["test"])
    spark.catalog.refreshByPath(f"{made.folder}/forecasts")
    assert tuple(made.forecasts(spark, "test").agg(F.sum("m2"), F.sum("q90"), F.count("*")).first()) == pytest.approx(tuple(total))


def test_backtest_scores(spark, made):
    from demandsense.plans import backtest
    scores = {r.model: r for r in trained.point_scores(made.forecasts(spark, "test"), backtest.mase_scale(made.inp, made.lay)).collect()}
    assert set(scores) == set(trained.POINT) and all(r.wape > 0 and r.mase > 0 for r in scores.values())
    rows = [r for r in made.forecasts(spark, "test").where("y IS NOT NULL AND NOT censored").collect()]
    for r in trained.head_scores(made.forecasts(spark, "test")).collect():
        e = np.array([x.y - x[f"{r.kind[0]}{round(100 * r.prob)}"] for x in rows])
        assert r.pinball == pytest.approx(loss(e, r.prob)) and r.rows == len(rows) and r.below == pytest.approx((e <= 0).mean())


def test_outage_and_spike_against_the_saved_forecasts(spark, made):
    got = trained.weather_outage(made, spark).first()
    rows = made.forecasts(spark, "test").where("y IS NOT NULL AND NOT censored").toPandas()
    assert got.wape_normal == pytest.approx((rows.y - rows.m2).abs().sum() / rows.y.sum())
    assert got.wape_sales_only == pytest.approx((rows.y - rows.m1).abs().sum() / rows.y.sum())
    assert got.rows_flagged == got.rows == made.forecasts(spark, "test").count()
    assert got.passed == (got.wape_outage < got.wape_sales_only)
    shift = trained.search_spike(made, spark, "view").first()
    assert shift["shift"] >= 0 and shift.passed == (shift["shift"] < 0.05)


def test_bands_and_gate_values(spark, made):
    rows = trained.routed_bands(made, spark)
    assert rows.where("p10c > p90c OR p10c < 0 OR final IS NULL").count() == 0
    typed = rows.where("block = 'test'").withColumn("day_type", F.when(F.col("h") < 4, "festival").otherwise("normal"))
    values = {}
    for part in trained.gate_values(made, spark, rows, typed):
        values.update({r.gate: r.value for r in part.collect()})
    test = rows.where("block = 'test' AND y IS NOT NULL AND NOT censored").toPandas()
    assert values["wape_gain_vs_b0"] == pytest.approx(1 - (test.y - test.final).abs().sum() / (test.y - test.b0).abs().sum())
    assert values["coverage"] == pytest.approx(((test.y >= test.p10c) & (test.y <= test.p90c)).mean())
    near = test[test.h < 4]
    assert values["sensing_gain_event_days"] == pytest.approx(1 - (near.y - near.m2).abs().sum() / (near.y - near.m1).abs().sum())
    assert {"pinball_gain_vs_b1", "mase_intermittent_vs_b0", "mase_store", "stability"} <= set(values)
