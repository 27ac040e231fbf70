"""Named queries over a star schema: each runs one or more operators over whole tables."""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandsense.functions import scores
from demandsense.functions.counts import count_quantiles, poisson_quantiles
from demandsense.functions.lineage import checkpoint_dir, cut
from demandsense.functions.noise import hash_uniform
from demandsense.functions.numeric import clip
from demandsense.functions.text import escape_formula_columns
from demandsense.operators import (boosted, coldstart, conformal, contracts, decisions, features, forecast, globalmodel, hierarchy,
                                   history, inventory, layout, metrics, monitor, panel, reconcile, robustness)
from demandsense.operators.layout import Layout
from demandsense.plans import backtest, increment, orders as order_plan, trained
from demandsense.sources import feeds
from demandsense.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


#: Added to states of whole-number sales, which are short decimals at first and would lie on a rounding tie.
OFF_TIE = 1e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ============================================================ sources and sinks
@query
def feed_scan(spark: SparkSession, path: str) -> DataFrame:
    """Pruned scan with a pushed-down date filter, reduced per ship day."""
    line = Star(spark, path).table("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01"))
    return line.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("units"), F.count(F.lit(1)).alias("rows"))


@query
def order_export_cells(spark: SparkSession, path: str) -> DataFrame:
    """Export cells: formula-like strings get a leading quote, other columns stay."""
    o = Star(spark, path).table("orders")
    sign = F.when(F.col("o_orderstatus") == "F", "=").when(F.col("o_orderstatus") == "O", "-").otherwise("@")
    return escape_formula_columns(o.select("o_orderkey", F.concat(sign, F.col("o_orderpriority")).alias("cell"),
                                           "o_orderpriority", "o_totalprice"))


@query
def recent_history(spark: SparkSession, path: str) -> DataFrame:
    """Last 91 days of every store x category, wide to long, missing dropped."""
    star = Star(spark, path)
    start, n = star.window()
    p = history.with_masked(star.panel("store_category", start, n)).withColumnRenamed("series_id", "node_id")
    return feeds.recent_history(p, n - 1, 91, ("ym", "disc"))


# ============================================================ contracts
def _sales_feed(star: Star) -> DataFrame:
    """Line items in the shape of the sales feed, with the stock columns as stand-ins."""
    line = star.table("lineitem")
    units = F.col("l_quantity").cast("bigint")
    closing = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 0).otherwise(F.pmod("l_orderkey", F.lit(40)))
    return line.select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.to_date("l_shipdate").alias("date"),
        F.concat(F.lit("S"), F.lpad(F.pmod("l_suppkey", F.lit(100)).cast("string"), 2, "0")).alias("store_id"),
        F.concat(F.lit("I"), F.lpad(F.pmod("l_partkey", F.lit(1000)).cast("string"), 3, "0")).alias("item_id"),
        units.alias("units_sold"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (units + closing - F.when(F.col("l_tax") == 0.08, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("on_hand_open"),
        F.lit(0).cast("bigint").alias("receipts"), closing.cast("bigint").alias("on_hand_close"),
        F.col("l_suppkey"), F.col("l_partkey"))


def _dirty_feed(star: Star, last: date) -> DataFrame:
    return robustness.inject_defects(_sales_feed(star), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], last.isoformat(),
                                     duplicate=0.01, negative=0.02, null_price=0.02, future=0.01)


def _annotated(star: Star) -> DataFrame:
    """Dirty feed with the first broken rule per row; a row is a repeat of its feed key."""
    start, n = star.window()
    last = start + timedelta(days=n - 1)
    dirty = cut(_dirty_feed(star, last))          # read three times by the repeat check
    order = ["copy", "l_orderkey", "l_linenumber", "units_sold", "on_hand_open", "on_hand_close"]
    rules = contracts.sales_contract(last.isoformat()).rules
    return contracts.annotate(dirty, rules, keys=["date", "l_suppkey", "l_partkey"], order=order, gate=contracts.sales_schema_rules())


@query
def quarantine_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Every quarantined row with the first rule it breaks."""
    bad = contracts.quarantined_rows(_annotated(Star(spark, path)))
    return bad.select("l_orderkey", "l_linenumber", "copy", "date", "units_sold", "on_hand_open", "on_hand_close", "reason")


@query
def clean_feed_by_store(spark: SparkSession, path: str) -> DataFrame:
    """Clean side of the split, with the stockout flag, summed per store and day."""
    ok = contracts.with_stockout(contracts.clean_rows(_annotated(Star(spark, path))))
    return ok.groupBy("store_id", "date").agg(F.sum("units_sold").alias("units"), F.count_if("stockout").alias("stockouts"))


@query
def quality_report(spark: SparkSession, path: str) -> DataFrame:
    return contracts.quality_report(_annotated(Star(spark, path)))


@query
def observed_quality_report(spark: SparkSession, path: str) -> DataFrame:
    """The quality report, observed while the checked feed is written."""
    where = f"{checkpoint_dir(spark).rstrip('/')}/checked-{uuid.uuid4().hex}"
    sided = _annotated(Star(spark, path)).withColumn("outcome", F.when(F.col("reason").isNull(), "clean").otherwise("quarantine"))
    return contracts.observed_report(sided, lambda df: feeds.write_table(df, where, ["outcome"]))


@query
def incremental_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Line items as raw files by supplier; one folder of files goes, one comes, one is written anew; only those are read again.

    One row: rows and units of the table after the second run, whether it equals a full read of the raw files, and whether the
    number of files taken in is that of the new ones.
    """
    star, base = Star(spark, path), f"{checkpoint_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    line = star.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")

    def put(k: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/raw/part-{k}")

    def read(paths: list[str]) -> DataFrame:
        return feeds.read_parquet_feed(spark, paths)
    for k in range(3):
        put(k, line.where(F.pmod("l_suppkey", F.lit(5)) == k))
    increment.sync(spark, f"{base}/raw", f"{base}/out", read)
    put(0, line.limit(0))
    put(1, line.where(F.pmod("l_suppkey", F.lit(5)) == 1).withColumn("l_quantity", F.col("l_quantity") + 1))
    put(4, line.where(F.pmod("l_suppkey", F.lit(5)) == 4))
    diff = increment.sync(spark, f"{base}/raw", f"{base}/out", read)
    made, raw = increment.table(spark, f"{base}/out"), spark.read.schema(line.schema).option("recursiveFileLookup", True).parquet(f"{base}/raw")
    files = diff.agg(F.count_if(F.col("state").isin("added", "changed") & ~F.col("path").contains("part-2")).alias("fresh"), F.count_if(F.col("state") == "same").alias("same"),
                     F.count_if((F.col("state") == "same") & ~F.col("path").contains("part-2")).alias("wrong"), F.count_if(F.col("state") == "removed").alias("removed"))
    one, other = feeds.table_fingerprint(made.select(*line.columns)).withColumnRenamed("rows", "n"), feeds.table_fingerprint(raw).withColumnsRenamed({"rows": "raw_rows", "hash_sum": "raw_sum"})
    units = made.agg(F.sum("l_quantity").alias("units"))
    told = one.join(F.broadcast(other)).join(F.broadcast(files)).join(F.broadcast(units))  # one row each
    return told.select(F.col("n").alias("rows"), "units", (F.col("n").eqNullSafe(F.col("raw_rows")) & F.col("hash_sum").eqNullSafe(F.col("raw_sum"))).alias("equals_raw"),
                       ((F.col("fresh") > 0) & (F.col("same") > 0) & (F.col("removed") > 0) & (F.col("wrong") == 0)).alias("only_changes"))


@query
def unknown_keys(spark: SparkSession, path: str) -> DataFrame:
    """Referential check against the suppliers in credit and the small parts."""
    star = Star(spark, path)
    feed = star.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    known_s = star.table("supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    known_p = star.table("part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    out = contracts.flag_unknown_keys(feed, [(known_s, "l_suppkey"), (known_p, "l_partkey")])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "reason")


@query
def repeated_keys(spark: SparkSession, path: str) -> DataFrame:
    return contracts.repeated_keys(Star(spark, path).table("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def range_violations(spark: SparkSession, path: str) -> DataFrame:
    """All broken rules per customer row (lazy check): range, pattern, membership, null."""
    c = Star(spark, path).table("customer")
    contract = contracts.Contract(
        columns={}, rules=[("balance", contracts.outside("c_acctbal", 0.0, 5000.0)), ("name", contracts.unmatched("c_name", r"^Customer#\d*[02468]$")),
                           ("segment", contracts.not_among("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"]))],
        unique=["c_custkey"], not_null=["c_custkey", "c_name"])
    bad = contracts.violations(c, contract)
    return bad.select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@query
def dirty_feed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Injected defects next to what the contract caught."""
    return robustness.defect_counts(_annotated(Star(spark, path)))


# ============================================================ panel
@query
def series_dimension(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    start, _ = star.window()
    launch = star.daily("item_store").groupBy("item_id").agg(F.min("date").alias("launch_date"))
    items = star.items().join(launch, "item_id")
    out = panel.series_dimension(star.stores().drop("n_nationkey"), items, start)
    return out.select("node_id", "store_id", "item_id", "category", "region", "store_idx", "region_idx", "cat_idx", "launch_idx", "price", "pack_size")


@query
def dense_grid(spark: SparkSession, path: str) -> DataFrame:
    """Store-day grid from launch on; days without sales are missing, not zero."""
    star = Star(spark, path)
    start, n = star.window()
    daily = star.daily("store").withColumn("day_idx", F.datediff("date", F.lit(start)))
    series = daily.groupBy("series_id").agg((F.greatest(F.min("day_idx") - 3, F.lit(0))).alias("launch_idx"))
    return panel.dense_panel(series, daily, n - 1)


@query
def promotion_days(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    start, n = star.window()
    return panel.promotion_days(star.promotions("p_brand"), start, n - 1)


@query
def post_promotion_days(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    start, n = star.window()
    promos = star.promotions("p_brand")
    return panel.post_promotion_days(promos, panel.promotion_days(promos, start, n - 1), start, n - 1)


@query
def kept_promotions(spark: SparkSession, path: str) -> DataFrame:
    """Promotions left after overlaps within an item and region are dropped."""
    promos = Star(spark, path).sold_lines().groupBy(F.col("p_retailprice").cast("string").alias("item_id"), "region", "date").agg(
        F.max("l_discount").alias("discount"), F.max("l_quantity").alias("q"), F.min("l_orderkey").alias("promo_ord"))
    promos = promos.select("item_id", "region", F.col("date").alias("date_start"), F.date_add("date", (F.col("q") * 3).cast("int")).alias("date_end"),
                           "discount", "promo_ord")
    return panel.drop_overlapping_promotions(promos)


@query
def weather_precedence(spark: SparkSession, path: str) -> DataFrame:
    """Observed weather wins; issued values fill dates without observations (three in ten, scattered);
    plus the mean over all cities per day."""
    star = Star(spark, path)
    start, _ = star.window()
    w = cut(star.weather())
    observed = w.where(hash_uniform(F.lit("seen"), F.col("date")) >= 0.3)
    issued = w.select("date", "city", (F.col("temp_max") + 1).alias("temp_max"), "rain_mm")
    full = panel.observed_or_issued(observed, issued).withColumn("day_idx", F.datediff("date", F.lit(start)))
    return rounded(panel.with_all_entity(full, "city", ["temp_max", "rain_mm"]))


@query
def weather_gap_fill(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    w = star.weather()
    secondary = w.groupBy("date").agg(F.max("humidity").alias("humidity"), F.max("temp_max").alias("temp_max"))
    secondary = w.select("date", "city").join(secondary, "date")
    primary = w.withColumn("temp_max", F.when(F.col("rain_mm") > 0, F.col("temp_max")))
    return rounded(panel.fill_from_secondary(primary, secondary, ["temp_max", "humidity"]))


@query
def climatology(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    start, n = star.window()
    lay = layout.origin_layout(n)
    return rounded(history.climatology(star.weather_days(start), lay.train_end, start=start))


@query
def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    start, n = star.window()
    return star.event_days(start, n)


@query
def search_wide(spark: SparkSession, path: str) -> DataFrame:
    """Clipped interest per day, one column per category that the log has."""
    star = Star(spark, path)
    s = star.search().withColumn("search_index", clip("search_index", 0, 100))
    names = [r[0] for r in star.table("events").where("event_type is not null").select("event_type").distinct().orderBy("event_type").collect()]    # columns-to-be
    return panel.widen(s, "date", "category", "search_index", names)


@query
def hierarchy_nodes(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    leafs = star.daily("item_store").select("store_id", "region", "category", F.col("series_id").alias("node_id")).distinct()
    m = hierarchy.membership(leafs).groupBy("node_id", "level").agg(F.count(F.lit(1)).alias("leaves"))
    return hierarchy.tree_edges(leafs).join(m, ["node_id", "level"])


@query
def aggregate_panel(spark: SparkSession, path: str) -> DataFrame:
    """Node-day sums of every aggregate level from sparse item series."""
    star = Star(spark, path)
    start, _ = star.window()
    daily = star.daily("item_store").withColumn("day_idx", F.datediff("date", F.lit(start)))
    leaf = daily.withColumn("y", F.when(~F.col("stockout"), F.col("y")))
    return rounded(hierarchy.aggregate_panel(leaf).select("level", "node_id", "day_idx", "y", "disc"), 9)


# ============================================================ windows
@query
def rolling_history(spark: SparkSession, path: str) -> DataFrame:
    """Trailing statistics on every observed day of sparse item series."""
    star = Star(spark, path)
    start, _ = star.window()
    daily = star.daily("item_store").withColumn("day_idx", F.datediff("date", F.lit(start)))
    rows = history.with_rolling(history.with_masked(daily))
    return rounded(rows.select("series_id", "day_idx", "mean7", "mean28", "mean56", "std28", "zero28", "last_obs", "days_since_sale"))


@query
def weekly_rolling_history(spark: SparkSession, path: str) -> DataFrame:
    """The same statistics read at weekly origins, most of which have no sale of the item."""
    star = Star(spark, path)
    start, n = star.window()
    daily = star.daily("item_store").withColumn("day_idx", F.datediff("date", F.lit(start)))
    series = daily.groupBy("series_id").agg(F.min("day_idx").alias("launch_idx"))
    origins = layout.origin_layout(n).cal
    rows = history.trailing_at_origins(history.with_masked(daily), origins)
    since = history.with_days_since_sale(history.with_origins(daily, series, origins)).where("is_origin")
    rows = since.select("series_id", F.col("day_idx").alias("origin"), "days_since_sale").join(rows, ["series_id", "origin"], "left")
    return rounded(rows.select("series_id", "origin", "mean7", "mean28", "mean56", "std28", "zero28", "last_obs", "days_since_sale"))


@query
def search_features(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return rounded(history.search_stats(star.search_days(star.window()[1])))


@query
def same_weekday_lags(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    inp, lay = _panel_inputs(star)
    rows = history.trailing_at_origins(history.with_masked(inp.panel), lay.test)
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(lay.horizon)))).withColumn("day", F.col("origin") + F.col("h"))
    return rounded(rows.select("series_id", "origin", "h", history.weekday_value("sdw_mean", F.col("day")).alias("sdw_mean4")))


@query
def seasonal_scale(spark: SparkSession, path: str) -> DataFrame:
    """Seasonal-naive error per series (the MASE scale) with the median fallback."""
    inp, lay = _panel_inputs(Star(spark, path))
    return rounded(backtest.mase_scale(inp, lay))


@query
def last_sixty_rows(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return history.last_rows(star.daily("item_store").select("series_id", "date", "y"), ["series_id"], F.col("date").desc(), 60)


@query
def smoothed_level(spark: SparkSession, path: str) -> DataFrame:
    """Smoothed level after every day of every series."""
    inp, _ = _panel_inputs(Star(spark, path))
    return rounded(history.with_ses_level(history.with_masked(inp.panel)).select("series_id", F.col("day_idx").cast("long").alias("day_idx"), (F.col("level") + OFF_TIE).alias("level")))


@query
def intermittent_states(spark: SparkSession, path: str) -> DataFrame:
    """Intermittent forecasts after every day of every series."""
    inp, _ = _panel_inputs(Star(spark, path))
    rows = history.with_intermittent(history.with_masked(inp.panel))
    return rounded(rows.select("series_id", F.col("day_idx").cast("long").alias("day_idx"), *[(F.col(c) + OFF_TIE).alias(c) for c in ("croston", "sba", "tsb")]))


# ============================================================ features
@query
def origin_layout(spark: SparkSession, path: str) -> DataFrame:
    return layout.layout_frame(spark, Star(spark, path).layout())


@query
def block_windows(spark: SparkSession, path: str) -> DataFrame:
    lay = Star(spark, path).layout()
    return layout.block_windows(layout.layout_frame(spark, lay), lay.horizon)


@query
def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every feature of the calibration and test blocks."""
    inp, lay = Star(spark, path).inputs()
    rows = features.build_features(inp, lay.cal + lay.test, lay.horizon)
    return rounded(rows.select("series_id", "origin", "day", *features.MULTISOURCE, "y", "censored"))


@query
def production_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of the production origin, whose target days lie past the last observation."""
    inp, lay = Star(spark, path).inputs()
    rows = features.build_features(inp, [lay.production], lay.horizon, target=False)
    return rounded(rows.select("series_id", "origin", "day", *features.MULTISOURCE))


def _aggregate_inputs(star: Star):
    start, n = star.window()
    nodes = hierarchy.aggregate_panel(star.panel("store_category", start, n))
    series = nodes.select(F.col("node_id").alias("series_id"), "level").distinct().withColumn("launch_idx", F.lit(0))
    return features.Inputs(nodes.withColumnRenamed("node_id", "series_id"), series, start, n), layout.origin_layout(n)


def _node_inputs(star: Star):
    """Aggregate nodes with every covariate: a node reads the weather of its store and the search of its category, else the mean of all."""
    leaf, _ = star.inputs()
    inp, lay = _aggregate_inputs(star)
    leaves = star.daily("item_store").select("store_id", "region", "category", "item_id", F.col("series_id").alias("node_id")).distinct()
    traits = hierarchy.node_attributes(leaves.join(star.items().drop("category"), "item_id")).select(F.col("node_id").alias("series_id"), "price", "pack_size", "level_idx")
    nodes = leaf.series.select(F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), e.alias("series_id")) for lv, e in hierarchy.ancestor_ids()])).alias("n"), "store_id", "city", "search_key",
                               "store_idx", "cat_idx", "region_idx").select("n.*", "store_id", "city", "search_key", "store_idx", "cat_idx", "region_idx")
    of_store, of_category = F.col("level").isin("store", "store_category"), F.col("level") == "store_category"
    keyed = nodes.groupBy("series_id", "level").agg(F.min("city").alias("city"), F.min("search_key").alias("search_key"), *[F.min(c).alias(c) for c in ("store_idx", "cat_idx", "region_idx")])
    keyed = keyed.select("series_id", F.when(of_store, F.col("city")).otherwise(panel.ALL).alias("city"), F.when(of_category, F.col("search_key")).otherwise(panel.ALL).alias("search_key"),
                         F.when(of_store, F.col("store_idx")).alias("store_idx"), F.when(of_category, F.col("cat_idx")).alias("cat_idx"),
                         F.when(F.col("level") != "total", F.col("region_idx")).alias("region_idx"), F.lit(0).alias("launch_idx"))
    return features.Inputs(inp.panel, keyed.join(traits, "series_id", "left"), inp.start, inp.n_obs, events=leaf.events, weather=leaf.weather, climate=leaf.climate,
                           search=leaf.search, seed=leaf.seed), lay


def _with_node_promotions(rows: DataFrame, inp: features.Inputs) -> DataFrame:
    """The mean discount of a node's leaves on the target day."""
    given = inp.panel.select("series_id", F.col("day_idx").alias("day"), "disc", "post_promo")
    return rows.join(given, ["series_id", "day"], "left").withColumns({"disc": F.coalesce("disc", F.lit(0.0)), "post_promo": F.coalesce("post_promo", F.lit(0))})


@query
def aggregate_scaling(spark: SparkSession, path: str) -> DataFrame:
    """History of aggregate nodes divided by its own level at the origin, with the ratio target."""
    inp, lay = _aggregate_inputs(Star(spark, path))
    rows = features.scale_for_aggregate(features.build_features(inp, lay.test, lay.horizon))
    return rounded(rows.select("series_id", "origin", "h", "scale", *features.SCALED, "target_ratio"))


@query
def node_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Mean price and pack size, children and level code of the nodes over item x store leaves."""
    star = Star(spark, path)
    leaves = star.daily("item_store").select("store_id", "region", "category", "item_id", F.col("series_id").alias("node_id")).distinct()
    out = hierarchy.node_attributes(leaves.join(star.items().drop("category"), "item_id"))
    return rounded(out.select("node_id", "level", "level_idx", "price", "pack_size", "n_children"))


# ============================================================ forecasts
def _panel_inputs(star: Star) -> tuple[features.Inputs, Layout]:
    """Dense store x category panel with its series, without covariates."""
    start, n = star.window()
    p = star.panel("store_category", start, n).persist()
    series = p.groupBy("series_id", "store_id", "region", "category").agg(F.min("day_idx").alias("launch_idx"))
    return features.Inputs(p, series, start, n), layout.origin_layout(n)


def _forecasts(star: Star, blocks=("cal", "test"), shared: bool = False) -> tuple[DataFrame, features.Inputs, Layout]:
    """Base forecasts; m1 and m2 stand in for the two global models.

    ``shared``: the rows are read several times and so written as a table first; a single reader
    leaves them in its own plan, where states and columns that it does not use are pruned.
    """
    inp, lay = _panel_inputs(star)
    rows = backtest.base_rows(inp, lay, blocks, ["store_id", "region", "category"])
    rows = (rows.withColumn("m1", F.col("b1")).withColumn("m2", 0.5 * (F.col("b0") + F.col("b1")))
                .withColumn("m2_p10", 0.5 * F.col("m2")).withColumn("m2_p50", F.col("m2")).withColumn("m2_p90", 1.6 * F.col("m2") + 1.0)
                .withColumn("c1", F.col("m2")).withColumn("catmean", F.col("mean28")))
    return cut(rows) if shared else rows, inp, lay


def _final(star: Star, blocks=("cal", "test")):
    """Routed forecasts of the blocks."""
    rows, inp, lay = _forecasts(star, ("cal", *[b for b in blocks if b != "cal"]), shared=True)
    cal = rows.where("block = 'cal'")
    routed = backtest.routed(rows, cal, backtest.mase_scale(inp, lay), ["m2", "tsb", "sba", "croston", "c1", "catmean"])
    return routed, inp, lay


@query
def seasonal_naive(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    return rounded(rows.select("series_id", "origin", "h", "b0", "y", "censored"))


@query
def forecast_keys(spark: SparkSession, path: str) -> DataFrame:
    """Test forecasts with the series' keys, the target date and the origin's date."""
    rows, inp, _ = _forecasts(Star(spark, path), ["test"])
    out = panel.with_series_keys(rows.select("series_id", "origin", "day", "b0"), inp.series, inp.start, ["store_id", "category"])
    return rounded(out.select("series_id", "store_id", "category", "origin_date", "date", "b0"))


@query
def planner_baseline(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    return rounded(rows.select("series_id", "origin", "h", "b1", "croston", "sba", "tsb"))


@query
def count_bands(spark: SparkSession, path: str) -> DataFrame:
    """Negative-binomial or Poisson quantiles of every store x category at its test origins."""
    inp, lay = _panel_inputs(Star(spark, path))
    rows = history.trailing_at_origins(history.with_masked(inp.panel), lay.test)
    rows = rows.select("series_id", "origin", F.round("mean28", 6).alias("m"), F.round("std28", 6).alias("s"))
    rows = rows.withColumn("nb", count_quantiles(F.col("m"), F.col("s"))).withColumn("po", poisson_quantiles(F.col("m")))
    return rows.select("series_id", "origin", *[F.col(c)[i].alias(f"{c}_p{p}") for c in ("nb", "po") for i, p in enumerate((10, 50, 90))])


@query
def demand_classes(spark: SparkSession, path: str) -> DataFrame:
    inp, lay = _panel_inputs(Star(spark, path))
    return rounded(backtest.demand_classes(inp, lay))


@query
def training_targets(spark: SparkSession, path: str) -> DataFrame:
    """Training block target under the three treatments of censored days, per series."""
    rows, _, _ = _forecasts(Star(spark, path), ["train"], shared=True)
    out = None
    for how in ("ignore", "drop", "impute"):
        t = (features.training_target(rows, how).groupBy("series_id")
             .agg(F.count(F.lit(1)).alias("rows"), F.sum("y_train").alias("y_train")).withColumn("treatment", F.lit(how)))
        out = t if out is None else out.unionByName(t)
    return rounded(out, 4)


@query
def route_selection(spark: SparkSession, path: str) -> DataFrame:
    rows, inp, lay = _forecasts(Star(spark, path), ["cal"], shared=True)
    return rounded(forecast.select_routes(rows, backtest.mase_scale(inp, lay)))


@query
def routed_forecasts(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _final(Star(spark, path), ["test"])
    return rounded(rows.where("block = 'test'").select("series_id", "origin", "h", "route", "final", "cls_group"))


# ============================================================ cold start
def _cold(star: Star):
    """Item x store series at early origins, where many are young; ``final`` is mean28."""
    start, n = star.window()
    daily = star.daily("item_store").withColumn("day_idx", F.datediff("date", F.lit(start))).persist()
    # straight from the line items: a group each series, where ``daily`` holds one each series and day
    series = star.launches().withColumn("launch_idx", F.datediff("launch_date", F.lit(start))).drop("launch_date").join(
        star.items().drop("category"), "item_id").persist()        # a dimension table in practice
    origins = [n // 12 + layout.STEP * i for i in range(layout.N_TEST)]        # early, where many items are young
    return daily, series, origins, start, n


def _cold_rows(star: Star):
    daily, series, origins, start, n = _cold(star)
    keep = ["store_id", "category", "launch_idx"]
    # the days that an origin sees, picked among the line items before they are joined and grouped
    seen = star.daily("item_store").withColumn("day_idx", F.datediff("date", F.lit(start))).where(F.col("day_idx").between(origins[0] - 55, origins[-1]))
    recent = history.trailing_at_origins(history.with_masked(seen), origins).select("series_id", "origin", "mean28")
    stats = series.select("series_id", *keep, F.explode(F.array(*[F.lit(o) for o in origins])).alias("origin"))
    stats = stats.join(recent, ["series_id", "origin"], "left")
    rows = stats.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("day", F.col("origin") + F.col("h"))
    rows = rows.where("launch_idx <= day").withColumn("age", F.least(F.col("day") - F.col("launch_idx"), F.lit(365)))
    return rows.withColumn("final", F.coalesce("mean28", F.lit(0.0)) + F.col("h") * 0.125), stats, series, daily, origins


@query
def analog_items(spark: SparkSession, path: str) -> DataFrame:
    _, series, *_ = _cold(Star(spark, path))
    return rounded(coldstart.analog_table(series))


@query
def launch_ramp(spark: SparkSession, path: str) -> DataFrame:
    daily, series, _, _, n = _cold(Star(spark, path))
    return rounded(coldstart.launch_ramp(daily, series, n - 1))


@query
def cold_start_forecast(spark: SparkSession, path: str) -> DataFrame:
    rows, _, series, daily, origins = _cold_rows(Star(spark, path))
    ramp = coldstart.launch_ramp(daily, series, origins[0])
    out = coldstart.analog_forecast(rows, series, ramp)
    return rounded(out.where("age < 28").select("series_id", "origin", "h", "c1"))


@query
def category_mean_forecast(spark: SparkSession, path: str) -> DataFrame:
    rows, stats, *_ = _cold_rows(Star(spark, path))
    return rounded(coldstart.category_mean(rows, stats).where("age < 28").select("series_id", "origin", "h", "catmean"))


@query
def young_route(spark: SparkSession, path: str) -> DataFrame:
    rows, stats, series, daily, origins = _cold_rows(Star(spark, path))
    rows = coldstart.analog_forecast(rows, series, coldstart.launch_ramp(daily, series, origins[0]))
    rows = coldstart.category_mean(rows, stats).withColumn("m2", F.col("final"))
    act = daily.select("series_id", F.col("day_idx").alias("day"), "y", F.col("stockout").alias("censored"))
    return forecast.choose_young_route(rows.join(act, ["series_id", "day"], "left"))


# ============================================================ scores
@query
def region_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """Flagship: weekly seasonal-naive and planner forecasts of every series, WAPE and bias per region."""
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    return rounded(forecast.usable(rows).groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), scores.wape("y", "b0").alias("wape_b0"), scores.wape("y", "b1").alias("wape_b1"),
        scores.bias("y", "b0").alias("bias_b0")))


@query
def score_table(spark: SparkSession, path: str) -> DataFrame:
    """WAPE, MASE and bias per model on the test block."""
    rows, inp, lay = _forecasts(Star(spark, path), ["test"], shared=True)
    return rounded(metrics.score_block(forecast.usable(rows), ["b0", "b1", "m2", "tsb", "sba", "croston"], backtest.mase_scale(inp, lay)))


@query
def pinball_coverage(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    r = forecast.usable(rows)
    return rounded(r.groupBy("demand_class").agg(
        scores.mean_pinball("y", "m2_p10", "m2_p50", "m2_p90").alias("pinball"), scores.coverage("y", "m2_p10", "m2_p90").alias("coverage"),
        F.count(F.lit(1)).alias("rows")))


@query
def forecast_stability(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["test"], shared=True)
    return rounded(metrics.stability(rows.where("y IS NOT NULL"), ["b0", "b1", "m2"]))


@query
def forecast_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts next to the previous origin's forecast of the same day."""
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    out = metrics.with_previous_forecast(rows.select("series_id", "origin", "day", "m2"), "m2").where("prev IS NOT NULL")
    return rounded(out)


def _with_day_type(star: Star, rows: DataFrame, inp: features.Inputs, lay: Layout) -> DataFrame:
    start, n, last = inp.start, inp.n_obs, inp.n_obs - 1 + lay.horizon
    ev = (star.event_days(start, n, lay.horizon) if inp.events is None else inp.events).withColumnRenamed("day_idx", "day")
    promo = (panel.promotion_days(star.promotions(), start, last) if inp.promo is None else inp.promo).select(F.col("item_id").alias("category"), "region", F.col("day_idx").alias("day"), "disc")
    rain = (star.weather_days(start) if inp.weather is None else inp.weather).select(F.col("city").alias("store_id"), F.col("day_idx").alias("day"), "rain_mm")
    rows = (rows.join(ev, "day", "left").join(promo, ["category", "region", "day"], "left").join(rain, ["store_id", "day"], "left")
                .withColumn("disc", F.coalesce("disc", F.lit(0.0))))
    return rows.withColumn("day_type", metrics.day_type(F.col("rain_mm") * 10))


@query
def wape_cuts(spark: SparkSession, path: str) -> DataFrame:
    """WAPE by demand class, day type and store in one pass."""
    star = Star(spark, path)
    rows, inp, lay = _forecasts(star, ["cal"], shared=True)
    rows = _with_day_type(star, forecast.usable(rows), inp, lay)
    return rounded(metrics.wape_cuts(rows, ["b0", "b1", "m2"], ["demand_class", "day_type", "store_id"]))


@query
def sensing_days(spark: SparkSession, path: str) -> DataFrame:
    """WAPE on festival and heavy-rain days only."""
    star = Star(spark, path)
    rows, inp, lay = _forecasts(star, ["cal"])
    rows = _with_day_type(star, forecast.usable(rows), inp, lay).where(F.col("day_type").isin("festival", "heavy_rain"))
    return rounded(rows.agg(scores.wape("y", "m1").alias("m1"), scores.wape("y", "m2").alias("m2"), F.count(F.lit(1)).alias("rows")))


@query
def store_level_mase(spark: SparkSession, path: str) -> DataFrame:
    rows, inp, lay = _forecasts(Star(spark, path), ["test"], shared=True)
    return rounded(metrics.store_mase(forecast.usable(rows), history.with_masked(inp.panel), lay.train_end, ["b0", "b1", "m2"]))


def _truth(star: Star, inp: features.Inputs) -> DataFrame:
    """True demand stand-in: sales before returns."""
    return star.sold_lines().groupBy("store_id", "category", F.datediff("date", F.lit(inp.start)).alias("day")).agg(
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(F.col("l_quantity") + 5)).alias("demand"))


@query
def accuracy_vs_truth(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts against an alternate truth: demand before returns, per store, category and day."""
    star = Star(spark, path)
    rows, inp, lay = _forecasts(star, ["test"])
    return rounded(metrics.truth_accuracy(rows, _truth(star, inp), ["store_id", "category", "day"], "m2"))


@query
def residual_spread(spark: SparkSession, path: str) -> DataFrame:
    rows, inp, _ = _forecasts(Star(spark, path), ["cal"], shared=True)
    return rounded(metrics.residual_sd(forecast.usable(rows), inp.series, "m2"))


# ============================================================ conformal
@query
def conformal_adjustments(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["cal"], shared=True)
    rows = rows.withColumn("cls_group", F.col("demand_class"))
    return rounded(conformal.fit(forecast.usable(rows), lo="m2_p10", hi="m2_p90"))


@query
def conformal_bands(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), shared=True)
    rows = rows.withColumn("cls_group", F.col("demand_class"))
    fitted = conformal.fit(forecast.usable(rows.where("block = 'cal'")), lo="m2_p10", hi="m2_p90")
    out = conformal.apply(rows.where("block = 'test'"), fitted, "m2_p10", "m2_p90")
    return rounded(out.select("series_id", "origin", "h", "bucket", "p10c", "p90c"))


# ============================================================ reconciliation
def _reconcile_inputs(star: Star):
    """(base grid per block, actuals, cases): planner forecasts at all five levels; each store x
    category carries one leaf."""
    inp, lay = _panel_inputs(star)
    series = inp.series.withColumnRenamed("series_id", "node_id")
    leaf_ids = series.withColumn("node_id", F.concat(F.col("node_id"), F.lit("|leaf")))
    tree = hierarchy.tree_edges(leaf_ids)
    rows = backtest.base_rows(inp, lay, ["cal", "test"])
    leaves = rows.select(F.concat("series_id", F.lit("|leaf")).alias("node_id"), "origin", "day", F.round("b1", 6).alias("base"))
    nodes = hierarchy.aggregate_panel(inp.panel)
    agg_inp = features.Inputs(nodes.withColumnRenamed("node_id", "series_id"),
                              nodes.select(F.col("node_id").alias("series_id")).distinct().withColumn("launch_idx", F.lit(0)), inp.start, inp.n_obs)
    agg = backtest.base_rows(agg_inp, lay, ["cal", "test"]).select(F.col("series_id").alias("node_id"), "origin", "day", F.round("b1", 6).alias("base"))
    fc = leaves.unionByName(agg)
    acts = nodes.select("node_id", F.col("day_idx").alias("day"), "y").unionByName(
        inp.panel.select(F.concat("series_id", F.lit("|leaf")).alias("node_id"), F.col("day_idx").alias("day"), "y"))
    cases = {b: [(o, o + h) for o in lay.block(b) for h in range(1, lay.horizon + 1)] for b in ("cal", "test")}
    fc, tree = cut(fc), cut(tree)
    base = {b: cut(reconcile.assemble(tree, cases[b], fc)) for b in ("cal", "test")}
    return base, cut(acts), cases


@query
def bottom_up_forecasts(spark: SparkSession, path: str) -> DataFrame:
    base, _, _ = _reconcile_inputs(Star(spark, path))
    out = reconcile.bottom_up(base["test"])
    return rounded(out.select("node_id", "level", "origin", "day", "bottom_up"))


def _wls(star: Star):
    base, acts, cases = _reconcile_inputs(star)
    res = reconcile.residuals(base["cal"], acts)
    weights = reconcile.variance_weights(reconcile.residual_scale(res))
    return base, acts, reconcile.non_negative(reconcile.tree_gls(base["test"], weights), "reconciled"), cases, res


@query
def wls_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Variance-weighted reconciliation of the aggregate nodes next to base and actual."""
    base, acts, rec, _, _ = _wls(Star(spark, path))
    return rounded(reconcile.node_forecasts(base["test"], rec, acts).select("node_id", "level", "origin", "day", "base", "reconciled", "y"))


@query
def coherence_check(spark: SparkSession, path: str) -> DataFrame:
    """Coherence error of the base forecasts and of each method (0 after, at 4 digits)."""
    base, _, rec, cases, res = _wls(Star(spark, path))
    tree = base["test"].select("node_id", "path").distinct()
    made = {"base": (base["test"], "yhat"), "bottom_up": (reconcile.bottom_up(base["test"]), "bottom_up"), "wls": (rec, "reconciled"),
            "mint": (reconcile.mint_shrink(base["test"], cut(res), cases["cal"], cases["test"]), "reconciled")}
    return rounded(reduce(DataFrame.unionByName, [reconcile.coherence_error(df, tree, c).withColumn("method", F.lit(m)) for m, (df, c) in made.items()]), 4)


@query
def wape_by_level(spark: SparkSession, path: str) -> DataFrame:
    base, acts, rec, _, _ = _wls(Star(spark, path))
    rows = (base["test"].join(rec.select("node_id", "origin", "day", "reconciled"), ["node_id", "origin", "day"])
            .join(reconcile.bottom_up(base["test"]).drop("level"), ["node_id", "origin", "day"])
            .join(acts, ["node_id", "day"], "left").withColumnRenamed("yhat", "base"))
    return rounded(metrics.wape_by_level(rows, ["base", "bottom_up", "reconciled"]))


def _by_method(star: Star) -> DataFrame:
    """Test rows of every node with the forecast of each reconciliation method."""
    base, acts, rec, cases, res = _wls(star)
    mint = reconcile.mint_shrink(base["test"], cut(res), cases["cal"], cases["test"])
    keys = ["node_id", "origin", "day"]
    return (base["test"].withColumnRenamed("yhat", "base").join(reconcile.bottom_up(base["test"]).drop("level"), keys)
            .join(rec.select(*keys, F.col("reconciled").alias("wls")), keys).join(mint.select(*keys, F.col("reconciled").alias("mint")), keys)
            .join(acts, ["node_id", "day"], "left"))


@query
def wape_levels_methods(spark: SparkSession, path: str) -> DataFrame:
    """Five levels by four methods, whole and by half of the horizon, from one scan."""
    rows = _by_method(Star(spark, path)).withColumn("lead", F.when(F.col("day") - F.col("origin") <= 7, "week 1").otherwise("week 2"))
    return metrics.wape_table(rows, ["base", "bottom_up", "wls", "mint"], ["lead"])


@query
def shrinkage_intensity(spark: SparkSession, path: str) -> DataFrame:
    base, acts, cases = _reconcile_inputs(Star(spark, path))
    res = reconcile.residuals(base["cal"], acts)
    vec = reconcile.case_vectors(res, reconcile.residual_scale(res))
    return rounded(reconcile.shrinkage(vec, len(cases["cal"])))


@query
def mint_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Shrunk-covariance reconciliation (checked against the dense formula in the tests)."""
    base, acts, cases = _reconcile_inputs(Star(spark, path))
    res = cut(reconcile.residuals(base["cal"], acts))
    return rounded(reconcile.mint_shrink(base["test"], res, cases["cal"], cases["test"]))


# ============================================================ inventory
def _banded(star: Star, blocks: list[str]) -> tuple[DataFrame, features.Inputs, Layout]:
    rows, inp, lay = _forecasts(star, blocks, shared=True)
    rows = rows.withColumn("final", F.col("m2")).withColumn("p10c", F.round("m2_p10", 6)).withColumn("p90c", F.round("m2_p90", 6))
    return rows, inp, lay


@query
def order_up_to_levels(spark: SparkSession, path: str) -> DataFrame:
    rows, inp, _ = _banded(Star(spark, path), ["cal", "test"])
    sd = metrics.residual_sd(forecast.usable(rows.where("block = 'cal'")), inp.series)
    return inventory.order_up_to(rows.where("block = 'test'"), sd)


def _on_hand(star: Star, inp: features.Inputs) -> DataFrame:
    """Stand-in stock: units of the last line item day of each series, 0 if it is not the last day."""
    sales = inp.panel.select("series_id", "day_idx", F.col("y").alias("on_hand_close"))
    return inventory.on_hand_snapshot(sales, inp.series, inp.n_obs - 1)


@query
def on_hand(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    inp, _ = _panel_inputs(star)
    return _on_hand(star, inp)


def _orders(star: Star) -> DataFrame:
    rows, inp, lay = _banded(star, ["production"])
    prod = rows.where("block = 'production'").withColumn("origin_date", F.date_add(F.lit(inp.start), F.col("origin")))
    series = inp.series.join(_on_hand(star, inp), "series_id")
    return inventory.production_orders(prod.select("series_id", "origin_date", "h", "final", "p10c", "p90c"), series)


@query
def production_orders(spark: SparkSession, path: str) -> DataFrame:
    return rounded(_orders(Star(spark, path)).select("series_id", "store_id", "category", "order_date", "mu", "p10", "p90", "order_up_to",
                                                     "on_hand", "suggested_qty", "policy"))


def _ledger(star: Star, inp: features.Inputs | None = None) -> DataFrame:
    """Recorded ledger stand-in: stock is the mean (or 1.5 x the mean) of the last week."""
    inp = inp or _panel_inputs(star)[0]
    mean7 = F.avg("y").over(history.trailing(7))
    rows = inp.panel.select("series_id", "day_idx", F.col("y").alias("demand"), mean7.alias("mean7"))
    rows = rows.withColumn("p", F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(k).alias("k")) for p, k in (("P0_manual", 1.0), ("P2_uncertainty", 1.5))])))
    stock = F.ceil(F.round(F.col("p.k") * F.col("mean7"), 9)).cast("double")
    rows = rows.select("series_id", "day_idx", "p.policy", "demand", stock.alias("stock"))
    sold = F.least("demand", "stock")
    return rows.select("series_id", "day_idx", "policy", "demand", (F.col("stock") - sold).alias("on_hand"), sold.alias("sold"),
                       (F.col("demand") - sold).alias("lost"), F.col("stock").alias("ordered"), F.lit(2.0).alias("price"))


@query
def ledger_indicators(spark: SparkSession, path: str) -> DataFrame:
    return rounded(inventory.ledger_kpis(_ledger(Star(spark, path))))


@query
def ledger_trace(spark: SparkSession, path: str) -> DataFrame:
    return rounded(inventory.ledger_trace(_ledger(Star(spark, path))))


@query
def policy_comparison(spark: SparkSession, path: str) -> DataFrame:
    return rounded(inventory.compare_policies(inventory.ledger_kpis(_ledger(Star(spark, path)))))


@query
def cover_at_fill(spark: SparkSession, path: str) -> DataFrame:
    """Per category: days of cover at three fill targets along the frontier given by its stores; NULL where it is not reached."""
    star = Star(spark, path)
    led = _ledger(star).where("policy = 'P2_uncertainty'")
    points = inventory.ledger_kpis(led.select("*", F.element_at(F.split("series_id", "\\|"), 1).alias("store"),
                                              F.element_at(F.split("series_id", "\\|"), 2).alias("category")).drop("policy"), ["category", "store"])
    points = points.select(F.col("category").alias("policy"), F.round("fill_rate", 6).alias("fill_rate"), F.round("avg_days_of_cover", 6).alias("days_of_cover"))
    points = cut(points)
    return rounded(reduce(DataFrame.unionByName, [inventory.cover_at_fill(points, t).withColumn("target", F.lit(t)) for t in (0.6, 0.8, 0.95)]), 5)


@query
def established_series(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _, _, origins = _cold_rows(Star(spark, path))
    return inventory.established_series(rows, origins[0])


@query
def origin_in_force(spark: SparkSession, path: str) -> DataFrame:
    """Latest test origin on or before each day, joined to that day's units per store."""
    star = Star(spark, path)
    start, n = star.window()
    lay = layout.origin_layout(n)
    days = star.daily("store").withColumn("day_idx", F.datediff("date", F.lit(start))).where(F.col("day_idx") >= lay.test[0])
    return inventory.latest_origin(days.select("store_id", "day_idx", "y"), lay.test)


# ============================================================ monitoring
@query
def drift_psi(spark: SparkSession, path: str) -> DataFrame:
    """Population stability of the data-driven features, training sample against test."""
    inp, lay = Star(spark, path).inputs()
    feats, recent = monitor.DRIFT_FEATURES, lay.train[-26:]
    rows = features.build_features(inp, recent + lay.test, lay.horizon)
    rows = cut(rounded(rows.select("series_id", "origin", "h", *[F.col(f).cast("double").alias(f) for f in feats])))
    ref = monitor.sample_rows(rows.where(F.col("origin") <= recent[-1]), 0.5, ["series_id", "origin", "h"], seed=7)
    return rounded(monitor.psi(ref, rows.where(F.col("origin") >= lay.test[0]), feats), 5)


@query
def weekly_accuracy(spark: SparkSession, path: str) -> DataFrame:
    rows, inp, _ = _forecasts(Star(spark, path), ["test"])
    rows = forecast.usable(rows).withColumn("final", F.col("m2")).withColumn("origin_date", F.date_add(F.lit(inp.start), F.col("origin")))
    return rounded(monitor.weekly_accuracy(rows))


@query
def store_bias_alerts(spark: SparkSession, path: str) -> DataFrame:
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    return rounded(monitor.store_bias(forecast.usable(rows).withColumn("final", F.col("m2"))))


@query
def demand_drop_detection(spark: SparkSession, path: str) -> DataFrame:
    """One store loses 20 % of demand: weeks until its weekly bias crosses the limit."""
    rows, _, _ = _forecasts(Star(spark, path), ["test"])
    rows = forecast.usable(rows).where("h <= 7").withColumn("final", F.col("m2"))
    bias = monitor.store_bias(robustness.drop_demand(rows, "NATION_1"))
    return monitor.detection_lag(bias)


@query
def source_freshness(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return monitor.freshness({"sales": (star.table("lineitem"), F.to_date("l_shipdate")), "weather": (star.table("orders"), F.to_date("o_orderdate")),
                              "search": (star.table("events"), F.to_date("ts"))})


@query
def latency_summary(spark: SparkSession, path: str) -> DataFrame:
    """Event log read as a request log: value is the latency, event type error a failure."""
    ev = Star(spark, path).table("events")
    return rounded(monitor.latency_summary(ev, "value", F.col("event_type") != "error"))


# ============================================================ robustness
PROBED = ["last_obs", "mean7", "mean28", "mean56", "std28", "zero28", "sdw_mean4", "days_since_sale", "age", "disc", "post_promo",
          "temp_fc", "rain_fc", "hum_fc", "wx_missing", "search_o", "search_mean7", "search_ratio", "search_trend"]


@query
def leakage_probe(spark: SparkSession, path: str) -> DataFrame:
    """Features rebuilt after scrambling the future: the largest change per feature is 0."""
    return _leakage(*Star(spark, path).inputs())


def _leakage(inp: features.Inputs, lay: Layout) -> DataFrame:
    return robustness.leakage_probe(inp, lay.test[0], lay.horizon, PROBED)


@query
def weather_outage(spark: SparkSession, path: str) -> DataFrame:
    """Weather feed missing over the calibration window: every row falls back and is flagged."""
    inp, lay = Star(spark, path).inputs()
    gone = robustness.blank_weather(inp.weather, lay.cal[0] + 1, lay.cal[-1] + lay.horizon)
    rows = features.build_features(features.Inputs(**{**inp.__dict__, "weather": gone}), lay.cal, lay.horizon, target=False)
    return rounded(rows.groupBy("city", "month").agg(F.count(F.lit(1)).alias("rows"), F.sum("wx_missing").alias("flagged"),
                                                     F.avg("temp_fc").alias("temp_fc"), F.avg("rain_fc").alias("rain_fc")))


@query
def search_spike(spark: SparkSession, path: str) -> DataFrame:
    """One category pinned at 100 for the two days before each origin."""
    star = Star(spark, path)
    _, n = star.window()
    search = star.search_days(n)
    origins = layout.origin_layout(n).test
    before = history.search_stats(search)
    after = history.search_stats(robustness.spike_search(search, "view", [*origins, n - 1]))
    both = before.join(after.select("category", "day_idx", F.col("search_o").alias("spiked")), ["category", "day_idx"])
    return rounded(both.select("category", "day_idx", "search_o", "spiked"))


@query
def search_spike_shift(spark: SparkSession, path: str) -> DataFrame:
    """Per category: how far the spike moves the robust search feature, against the 5 % limit."""
    both = search_spike(spark, path)
    before = both.select("category", "day_idx", "search_o")
    after = both.select("category", "day_idx", F.col("spiked").alias("search_o"))
    return rounded(robustness.relative_shift(before, after, ["category", "day_idx"], "search_o", by=["category"]))


# ============================================================ decisions
REASONS = ["promo", "weather", "stock", "other"]


def _decisions(star: Star) -> DataFrame:
    """Event log as incoming decisions."""
    ev = star.table("events")
    kind = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"), F.concat(F.lit("S"), F.lpad(F.pmod("user_id", F.lit(20)).cast("string"), 2, "0")).alias("store_id"),
        F.concat(F.lit("I"), F.lpad(F.pmod("event_id", F.lit(40)).cast("string"), F.when(F.pmod("event_id", F.lit(97)) == 0, 2).otherwise(3), F.lit("0"))).alias("item_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("order_date"),
        F.when(kind == "view", "approve").when(kind == "click", "override").when(kind == "purchase", "reject").when(kind == "signup", "approve").otherwise("skip").alias("action"),
        F.floor(F.col("value") * F.when(F.pmod("event_id", F.lit(50)) == 0, 1000).otherwise(1)).cast("bigint").alias("final_qty"),
        F.when(kind.isin("click", "purchase"), F.get(F.array(F.lit("promo"), F.lit("weather"), F.lit("bogus"), F.lit(None)), F.pmod("event_id", F.lit(4)).cast("int"))).alias("reason_code"),
        F.concat(F.lit("  "), F.repeat("props", F.pmod("event_id", F.lit(45)).cast("int"))).alias("note"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_name"))


def _suggested(star: Star) -> DataFrame:
    """Suggested orders per store and item of the decision stand-in: purchases so far."""
    ev = star.table("events")
    return (ev.where("event_type <> 'error'").groupBy(
        F.concat(F.lit("S"), F.lpad(F.pmod("user_id", F.lit(20)).cast("string"), 2, "0")).alias("store_id"),
        F.concat(F.lit("I"), F.lpad(F.pmod("event_id", F.lit(40)).cast("string"), 3, "0")).alias("item_id"))
        .agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("order_date"), F.floor(F.max("value") / 10).cast("bigint").alias("suggested_qty")))


@query
def decision_validation(spark: SparkSession, path: str) -> DataFrame:
    out = decisions.validate_decisions(_decisions(Star(spark, path)), decisions.decision_rules(REASONS))
    return out.select("id", "action", "final_qty", F.length("note").alias("note_length"), "reason")


@query
def decision_outcomes(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    out = order_plan.process_decisions(_decisions(star), _suggested(star), decisions.decision_rules(REASONS))
    return out.select("id", "store_id", "item_id", "action", "suggested_qty", "final_qty", "reason")


def _log(star: Star) -> DataFrame:
    """Decisions that passed the rules and the guard, with what was suggested and what was settled on."""
    done = order_plan.process_decisions(_decisions(star), _suggested(star), decisions.decision_rules(REASONS))
    return decisions.accepted(done, "m2").drop("note", "reason_code")


@query
def decision_append(spark: SparkSession, path: str) -> DataFrame:
    """Decisions that arrive as files, some of them twice, through the stream; per store and action what the log holds.

    The even ids come first, then all of them; a third run finds nothing to do.
    """
    star, base = Star(spark, path), f"{checkpoint_dir(spark).rstrip('/')}/decisions-{uuid.uuid4().hex}"
    incoming, orders = _decisions(star), cut(_suggested(star))
    schema = incoming.schema
    for rows in (incoming.where(F.pmod("id", F.lit(2)) == 0), incoming, None):
        if rows is not None:
            rows.write.mode("append").parquet(f"{base}/incoming")
        order_plan.append_stream(spark, f"{base}/incoming", schema, orders, decisions.decision_rules(REASONS), f"{base}/log", f"{base}/state", "m2")
    log = spark.read.parquet(f"{base}/log")
    return log.groupBy("store_id", "action").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.sum(F.when(F.col("reason").isNull(), F.col("final_qty"))).alias("units"),
                                                F.count_if(F.col("reason") == order_plan.REPEATED).alias("repeated"), F.count(F.lit(1)).alias("rows"))


@query
def latest_decisions(spark: SparkSession, path: str) -> DataFrame:
    return decisions.latest_decisions(_log(Star(spark, path)))


@query
def order_review(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return decisions.order_review(_suggested(star), _log(star))


@query
def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return decisions.audit_log(_log(Star(spark, path)), 200, "S03")


@query
def store_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items per store for the stores one user may see."""
    star = Star(spark, path)
    series = star.daily("item_store").select("store_id", "region", "item_id").distinct()
    cat = decisions.store_catalogue(series, "region")
    ent = star.stores().select("store_id", F.concat(F.lit("manager of "), F.col("region")).alias("user"))
    return decisions.in_scope(cat, ent, "manager of ASIA")


@query
def item_catalogue(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    series = star.daily("item_store").select("store_id", "item_id", "category").distinct().join(star.items().drop("category"), "item_id")
    return decisions.item_catalogue(series, "NATION_3", ["item_id", "category", "price", "pack_size"])


@query
def store_forecast_view(spark: SparkSession, path: str) -> DataFrame:
    """Base and reconciled forecasts and observed units of one store and its categories, with readable labels."""
    base, acts, rec, _, _ = _wls(Star(spark, path))
    nodes = reconcile.node_forecasts(base["test"], rec, acts).select("node_id", "level", "origin", "day", "base", "reconciled", "y")
    return rounded(decisions.store_forecast(nodes, "NATION_3"))


@query
def item_forecast_view(spark: SparkSession, path: str) -> DataFrame:
    """Per series: the last 60 days, the band of the production origin, and its effects, strongest first."""
    rows, inp, _ = _banded(Star(spark, path), ["production"])
    rows = rows.where("block = 'production'")
    drivers = rows.select("series_id", F.log((F.col("b1") + 1) / (F.col("mean28") + 1)).alias("drv_a"), F.log((F.col("b0") + 1) / (F.col("mean28") + 1)).alias("drv_b"))
    drivers = decisions.ranked_drivers(drivers, {"drv_a": "planner", "drv_b": "last week"}, ["series_id"])
    none = F.lit(None).cast("double")
    past = inp.panel.where(F.col("day_idx") > inp.n_obs - 1 - 60).select("series_id", F.lit("history").alias("part"), F.col("day_idx").cast("long").alias("at_day"), F.col("y").alias("value"), none.alias("p10"), none.alias("p90"))
    band = rows.select("series_id", F.lit("forecast").alias("part"), F.col("day").cast("long").alias("at_day"), F.col("final").alias("value"), F.col("p10c").alias("p10"), F.col("p90c").alias("p90"))
    ranked = drivers.select("series_id", F.posexplode("drivers").alias("at_day", "d"))
    effects = ranked.select("series_id", F.concat(F.lit("effect of "), F.col("d.factor")).alias("part"), F.col("at_day").cast("long").alias("at_day"), F.col("d.effect_pct").alias("value"), none.alias("p10"), none.alias("p90"))
    return rounded(past.unionByName(band).unionByName(effects))


@query
def normalised_output(spark: SparkSession, path: str) -> DataFrame:
    o = Star(spark, path).table("orders")
    return decisions.normalised(o.select("o_orderkey", (F.col("o_totalprice") / 7).alias("price"), "o_orderdate", "o_orderstatus",
                                         F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("finite_only")))


@query
def gate_results(spark: SparkSession, path: str) -> DataFrame:
    """Go / no-go gates over measured scores."""
    rows, inp, lay = _forecasts(Star(spark, path), ["test"])
    agg = forecast.usable(rows).agg(scores.wape("y", "m2").alias("m2"), scores.wape("y", "b0").alias("b0"), scores.coverage("y", "m2_p10", "m2_p90").alias("cov"))
    gates = {"wape_gain_vs_b0": 1 - F.col("m2") / F.col("b0"), "coverage": F.col("cov"), "wape_max": F.col("m2")}
    values = agg.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("gate"), v.alias("value")) for g, v in gates.items()])).alias("g")).select("g.*")
    limits = spark.createDataFrame([("wape_gain_vs_b0", 0.10, None, False), ("coverage", 0.75, 0.85, False), ("wape_max", None, 1.0, True),
                                    ("latency_p95", None, 300.0, True)], "gate string, low double, high double, strict boolean")
    return rounded(metrics.evaluate_gates(values, limits))


# ============================================================ global models
def _modelled(star: Star):
    """Point models on the training block and their forecasts of the test block."""
    inp, lay = star.inputs()
    train = cut(features.training_target(features.build_features(inp, lay.train, lay.horizon)))
    return train, cut(features.build_features(inp, lay.test, lay.horizon)), inp, lay


@query
def global_model_scores(spark: SparkSession, path: str) -> DataFrame:
    """Sales-only and multisource Tweedie models, with quantile heads, scored on the test block."""
    train, test, inp, lay = _modelled(Star(spark, path))
    classes = backtest.demand_classes(inp, lay).select("series_id", "demand_class")
    m1 = globalmodel.fit_point_model(train, features.SALES_ONLY)
    m2 = globalmodel.fit_point_model(train, features.MULTISOURCE)
    ratios = globalmodel.residual_ratio_quantiles(m2.predict(train, "m2").join(classes, "series_id"))
    rows = forecast.usable(m2.predict(m1.predict(test, "m1"), "m2")).join(classes, "series_id")
    rows = globalmodel.with_quantile_heads(rows, ratios)
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), scores.wape("y", "m1").alias("wape_m1"), scores.wape("y", "m2").alias("wape_m2"),
                                      scores.coverage("y", "m2_p10", "m2_p90").alias("coverage"))


def _trained(star: Star) -> trained.Backtest:
    """The backtest on trained models; the first query of a session that needs it makes it."""
    inp, lay = star.inputs()
    return trained.run(star.spark, inp, lay, trained.folder_for(star.spark, star.path))


@query
def trained_scores(spark: SparkSession, path: str) -> DataFrame:
    """Seasonal naive, planner, Tweedie and boosted models on the test block, in one table."""
    made = _trained(Star(spark, path))
    return trained.point_scores(made.forecasts(spark, "test"), backtest.mase_scale(made.inp, made.lay))


@query
def quantile_head_scores(spark: SparkSession, path: str) -> DataFrame:
    """Pinball loss of the fitted quantile heads beside the ratio heads."""
    return trained.head_scores(_trained(Star(spark, path)).forecasts(spark, "test"))


@query
def trained_importance(spark: SparkSession, path: str) -> DataFrame:
    """Gain of each feature in the boosted model and of its family."""
    made = _trained(Star(spark, path))
    rows = spark.createDataFrame(boosted.BoostedModel.load(spark, f"{made.folder}/models/m2").importance(), "feature string, family string, gain double")
    return rows.withColumn("family_gain", F.sum("gain").over(Window.partitionBy("family")))  # one row a feature


@query
def forecast_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The forecast table by block after the test block was made again from the saved models; the other block is as it was."""
    made = _trained(Star(spark, path))
    where = f"{checkpoint_dir(spark).rstrip('/')}/forecasts-{uuid.uuid4().hex}"
    feeds.write_blocks(made.forecasts(spark), where)
    before = cut(feeds.table_fingerprint(spark.read.parquet(where), "block"))
    feeds.write_blocks(trained.forecast_block(spark, made.inp, made.lay, made.folder, ["test"]), where)
    now = spark.read.parquet(where)
    after = feeds.table_fingerprint(now, "block").select("block", F.col("rows").alias("n"), F.col("hash_sum").alias("now_sum"))
    same = (F.col("rows") == F.col("n")) & ((F.col("block") == "test") | (F.col("hash_sum") == F.col("now_sum")))
    sums = now.groupBy("block").agg(F.round(F.sum("b0"), 3).alias("b0"), F.round(F.sum("b1"), 3).alias("b1"))
    return before.join(after, "block").join(sums, "block").select("block", F.col("n").alias("rows"), "b0", "b1", same.alias("as_before"))


@query
def aggregate_model_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Ratio model of the aggregate nodes, fitted on training origins, applied to test origins."""
    inp, lay = _node_inputs(Star(spark, path))
    train, test = (cut(features.scale_for_aggregate(_with_node_promotions(features.build_features(inp, o, lay.horizon), inp))) for o in (lay.train, lay.test))
    model = globalmodel.fit_aggregate_model(train, [*features.MULTISOURCE, "level_idx"])
    return globalmodel.aggregate_forecast(model, test).select("series_id", "origin", "day", "base", "y")


@query
def driver_effects(spark: SparkSession, path: str) -> DataFrame:
    """Mean absolute log contribution per feature family and its share of the total."""
    train, test, _, _ = _modelled(Star(spark, path))
    model = globalmodel.fit_point_model(train, features.MULTISOURCE)
    drivers = globalmodel.mean_abs_drivers(globalmodel.driver_families(model, test))
    gain = globalmodel.importance_by_family(globalmodel.feature_importance(model, test)).withColumn("family", F.replace("family", F.lit("/"), F.lit("_")))
    return drivers.join(gain, "family")


@query
def partial_dependence(spark: SparkSession, path: str) -> DataFrame:
    train, test, _, _ = _modelled(Star(spark, path))
    model = globalmodel.fit_point_model(train, features.MULTISOURCE)
    return globalmodel.partial_dependence(model, test.where("h <= 2"), "temp_fc", [5.0, 10.0, 20.0, 30.0, 40.0])


@query
def censoring_ablation(spark: SparkSession, path: str) -> DataFrame:
    """Bias of the model under the three treatments of censored days."""
    star = Star(spark, path)
    inp, lay = star.inputs()
    return trained.censoring(inp, lay, _truth(star, inp), ["store_id", "category", "day"])


@query
def weather_outage_outcome(spark: SparkSession, path: str) -> DataFrame:
    """What an outage of the weather feed over the test block costs the boosted model."""
    return trained.weather_outage(_trained(Star(spark, path)), spark)


@query
def search_spike_outcome(spark: SparkSession, path: str) -> DataFrame:
    """How far a spike of one search series moves the boosted model's forecasts, against the 5 % limit."""
    return trained.search_spike(_trained(Star(spark, path)), spark, "view")


@query
def trained_bands(spark: SparkSession, path: str) -> DataFrame:
    """Per demand class on the test block: routed forecast and its conformal band, from the trained models."""
    rows = forecast.usable(trained.routed_bands(_trained(Star(spark, path)), spark).where("block = 'test'"))
    return rows.groupBy("demand_class").agg(F.count(F.lit(1)).alias("rows"), scores.wape("y", "final").alias("wape"), scores.coverage("y", "p10", "p90").alias("coverage_raw"),
                                            scores.coverage("y", "p10c", "p90c").alias("coverage"), scores.mean_pinball("y", "p10c", "p50", "p90c").alias("pinball"))


# The thresholds of the gates (low, high, whether the bound itself fails).
GATES = [("wape_gain_vs_b0", 0.10, None, False), ("mase_store", None, 1.0, True), ("sensing_gain_event_days", 0.05, None, False), ("pinball_gain_vs_b1", 0.10, None, False),
         ("coverage", 0.75, 0.85, False), ("mase_intermittent_vs_b0", None, 1.0, False), ("coldstart_gain_vs_catmean", 0.10, None, False), ("coherence_error", None, 1e-6, True),
         ("fill_rate", 0.95, None, False), ("inventory_at_95_fill_vs_p0", None, 0.0, False), ("stockout_reduction_vs_p0", 0.20, None, False), ("stability", None, 0.15, False),
         ("leaking_features", None, 0.0, False), ("latency_p95_ms", None, 300.0, True), ("batch_minutes", None, 10.0, True)]


@query
def trained_gates(spark: SparkSession, path: str) -> DataFrame:
    """All fifteen gates from measured values: forecasts of the trained models, cold start, reconciliation, ledger, leakage, latency and run time."""
    began = time.monotonic()
    star = Star(spark, path)
    made = _trained(star)
    rows = cut(trained.routed_bands(made, spark))
    typed = _with_day_type(star, rows.where("block = 'test'").drop("disc", "in_festival", "days_to_event", "event_id", "is_holiday"), made.inp, made.lay)
    found = trained.gate_values(made, spark, rows, typed)

    def one(df: DataFrame, gate: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(gate).alias("gate"), "value")
    cold, stats, series, daily, origins = _cold_rows(star)
    ramp = coldstart.launch_ramp(daily, series, max(origins))
    young = coldstart.category_mean(coldstart.analog_forecast(cold, series, ramp), stats).where(F.col("age") < forecast.YOUNG_AGE)
    young = young.join(daily.select("series_id", F.col("day_idx").alias("day"), "y"), ["series_id", "day"])
    found.append(one(young, "coldstart_gain_vs_catmean", 1 - scores.wape("y", "c1") / scores.wape("y", "catmean")))
    base, _, rec, _, _ = _wls(star)
    found.append(one(reconcile.coherence_error(rec, base["test"].select("node_id", "path").distinct(), "reconciled"), "coherence_error", F.max("coherence_error")))
    kpis = cut(inventory.ledger_kpis(_ledger(star, made.inp)))
    manual, sure = F.col("policy") == inventory.POLICIES[0], F.col("policy") == inventory.POLICIES[2]
    found.append(one(kpis, "fill_rate", F.max(F.when(sure, F.col("fill_rate")))))
    points = inventory.ledger_kpis(_ledger(star, made.inp).withColumn("store", F.element_at(F.split("series_id", "\\|"), 1)), ["policy", "store"])
    cover = inventory.cover_at_fill(cut(points.select("policy", "fill_rate", F.col("avg_days_of_cover").alias("days_of_cover"))), 0.95)
    found.append(one(cover, "inventory_at_95_fill_vs_p0", F.max(F.when(sure, F.col("cover"))) / F.max(F.when(manual, F.col("cover"))) - 1))
    found.append(one(inventory.compare_policies(kpis), "stockout_reduction_vs_p0", F.max("stockout_reduction")))
    found.append(one(_leakage(made.inp, made.lay), "leaking_features", F.count_if(F.col("max_change") > 0)))
    found.append(one(latency_summary(spark, path), "latency_p95_ms", F.max("p95")))
    values = cut(reduce(DataFrame.unionByName, found))
    took = spark.createDataFrame([("batch_minutes", (time.monotonic() - began) / 60)], "gate string, value double")
    limits = spark.createDataFrame(GATES, "gate string, low double, high double, strict boolean")
    return metrics.evaluate_gates(values.unionByName(took), limits)
