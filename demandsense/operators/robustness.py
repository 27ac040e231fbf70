"""Fault injection: every job changes an input the way a real fault would and measures it."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.noise import hash_uniform
from demandsense.operators.features import Inputs, build_features


def scramble_future(inp: Inputs, origin: int) -> Inputs:
    """Replace everything observed after the origin with noise."""
    later = F.col("day_idx") > origin
    draw = hash_uniform(F.lit("y"), F.col("series_id"), F.col("day_idx"))
    panel = inp.panel.withColumn("y", F.when(later, F.floor(draw * 500).cast("double")).otherwise(F.col("y"))).withColumn(
        "stockout", F.when(later, hash_uniform(F.lit("so"), F.col("series_id"), F.col("day_idx")) < 0.5).otherwise(F.col("stockout")))
    search = inp.search
    if search is not None:
        noise = 100 * hash_uniform(F.lit("s"), F.col("category"), F.col("day_idx"))
        search = search.withColumn("search_index", F.when(later, noise).otherwise(F.col("search_index")))
    return replace(inp, panel=panel, search=search)


def leakage_probe(inp: Inputs, origin: int, horizon: int, features: Sequence[str]) -> DataFrame:
    """(feature, rows, max_change): features rebuilt on a scrambled future must not change."""
    keys = ["series_id", "origin", "h"]

    def long(x: Inputs, name: str) -> DataFrame:
        rows = build_features(x, [origin], horizon, target=False)
        vals = [F.coalesce(F.col(f).cast("double"), F.lit(-999.0)).alias(f) for f in features]
        return rows.select(*keys, *vals).unpivot(keys, list(features), "feature", name)

    both = long(inp, "before").join(long(scramble_future(inp, origin), "after"), [*keys, "feature"], "full")
    change = F.coalesce(F.abs(F.col("before") - F.col("after")), F.lit(float("inf")))
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.max(change).alias("max_change"))


def blank_weather(weather: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Weather feed missing in a window of days."""
    gone = F.col("day_idx").between(first_day, last_day)
    return weather.select("day_idx", "city", *[F.when(~gone, F.col(v)).alias(v) for v in ("temp_max", "rain_mm", "humidity")])


def spike_search(search: DataFrame, category: str, origins: Sequence[int], days: int = 2, value: float = 100.0) -> DataFrame:
    """Search index of one category pinned for the last ``days`` days up to each origin."""
    hit = F.lit(False)
    for o in origins:
        hit = hit | F.col("day_idx").between(o - days + 1, o)
    hit = hit & (F.col("category") == category)
    return search.withColumn("search_index", F.when(hit, F.lit(value)).otherwise(F.col("search_index")))


def relative_shift(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, limit: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """(by..., shift, passed): sum of absolute changes over the sum of values, one row a group."""
    b = after.select(*keys, F.col(value).alias("__after"))
    return before.join(b, list(keys)).groupBy(*by).agg(
        (F.sum(F.abs(F.col("__after") - F.col(value))) / F.greatest(F.sum(value), F.lit(1e-9))).alias("shift")).withColumn(
        "passed", F.col("shift") < limit)


def drop_demand(rows: DataFrame, store: str | Column, factor: float = 0.8) -> DataFrame:
    """One store sells only ``factor`` of its demand."""
    return rows.withColumn("y", F.when(F.col("store_id") == store, F.col("y") * factor).otherwise(F.col("y")))


def inject_defects(feed: DataFrame, keys: Sequence[str], last_date, duplicate: float, negative: float, null_price: float,
                   future: float, seed: int = 0) -> DataFrame:
    """Add duplicates, negative units, missing prices and rows dated after the last day at
    given rates, chosen by the hash of the row key.  ``copy`` is 1 on added rows, 0 elsewhere,
    and ``defect`` names what was done."""
    def chosen(kind: str, rate: float) -> Column:
        return hash_uniform(F.lit(seed), F.lit(kind), *[F.col(k) for k in keys]) < rate

    neg, nul = chosen("negative", negative), chosen("null_price", null_price)
    # duplicates and future rows are copies of the rows after the first two defects, as in a real feed
    base = feed.select(*[c for c in feed.columns if c not in ("units_sold", "unit_price")],
                       F.when(neg, -F.greatest("units_sold", F.lit(1))).otherwise(F.col("units_sold")).alias("units_sold"),
                       F.when(~nul, F.col("unit_price")).alias("unit_price"),
                       F.when(neg, "negative_units").when(nul, "bad_price").alias("defect"))
    later = F.date_add(F.lit(last_date).cast("date"),
                       (1 + F.floor(hash_uniform(F.lit(seed), F.lit("shift"), *[F.col(k) for k in keys]) * 29)).cast("int"))

    def entry(copy: int, kind: Column, on: Column) -> Column:
        return F.struct(F.lit(copy).alias("copy"), kind.alias("kind"), on.alias("on"))

    kinds = F.array_compact(F.array(
        entry(0, F.col("defect"), F.col("date")),
        F.when(chosen("duplicate", duplicate), entry(1, F.lit("duplicate_key"), F.col("date"))),
        F.when(chosen("future", future), entry(2, F.lit("date_in_future"), later))))
    rows = base.withColumn("__k", F.explode(kinds))
    return rows.select(*[c for c in base.columns if c not in ("defect", "date")], F.col("__k.on").alias("date"),
                       F.col("__k.copy").alias("copy"), F.col("__k.kind").alias("defect"))


def defect_counts(annotated: DataFrame) -> DataFrame:
    """(reason, injected, quarantined) side by side."""
    inj = annotated.where("defect IS NOT NULL").groupBy(F.col("defect").alias("reason")).agg(F.count(F.lit(1)).alias("injected"))
    got = annotated.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("quarantined"))
    return inj.join(got, "reason", "full").select("reason", F.coalesce("injected", F.lit(0)).alias("injected"),
                                                  F.coalesce("quarantined", F.lit(0)).alias("quarantined"))
