"""Feed-shaped views over a sales star schema (lineitem, part, supplier, nation, ...).

The star schema has no shelves, weather or launches, so each view is a stand-in that
feeds an operator with real, full tables.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.operators import history, panel
from demandsense.operators.features import Inputs
from demandsense.operators.layout import Layout, origin_layout
from demandsense.operators.panel import fill_gaps

# Event kinds of the stand-in calendar, and which search series a category reads.
EVENT_META = [("Year End", 5, 7), ("Spring Fair", 3, 4), ("Founders Day", 1, 1)]
SEARCH_KEYS = {"ECONOMY": "click", "LARGE": "error", "MEDIUM": "purchase", "SMALL": "signup", "STANDARD": "view"}


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def window(self) -> tuple[date, int]:
        """(first ship date, number of observed days): one aggregated row."""
        row = self.table("lineitem").agg(F.min(F.to_date("l_shipdate")).alias("lo"),
                                         F.max(F.to_date("l_shipdate")).alias("hi")).first()
        return row["lo"], (row["hi"] - row["lo"]).days + 1

    def stores(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return (nation.join(region, nation.n_regionkey == region.r_regionkey)
                .select("n_nationkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("region")))

    def sold_lines(self) -> DataFrame:
        """One row per line item with its store, region, category, item and day."""
        line, part, supplier = self.table("lineitem"), self.table("part"), self.table("supplier")
        shops = supplier.join(self.stores(), supplier.s_nationkey == F.col("n_nationkey")) \
                        .select("s_suppkey", "store_id", "region")
        goods = part.select("p_partkey", F.col("p_type").alias("category"), "p_brand", "p_retailprice", "p_size")
        return (line.join(goods, line.l_partkey == goods.p_partkey)
                    .join(shops, line.l_suppkey == shops.s_suppkey)
                    .withColumn("item_id", F.concat_ws("|", "category", "p_brand")).drop("p_brand")      # after the join, whose table stays narrow
                    .withColumn("date", F.to_date("l_shipdate")))

    def daily(self, level: str = "store_category") -> DataFrame:
        """Observed days per series: units, best discount, sold-out stand-in."""
        keys = {"store_category": ["store_id", "region", "category"],
                "store": ["store_id", "region"],
                "item_store": ["store_id", "region", "category", "item_id"]}[level]
        ident = {"store_category": ["store_id", "category"], "store": ["store_id"],
                 "item_store": ["store_id", "item_id"]}[level]
        return (self.sold_lines().groupBy(*keys, "date")
                .agg(F.sum("l_quantity").alias("y"), F.max("l_discount").alias("disc"),
                     F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).alias("stockout"))
                .withColumn("series_id", F.concat_ws("|", *ident)))

    def launches(self) -> DataFrame:
        """First day of each item x store series with sales."""
        return (self.sold_lines().groupBy("store_id", "category", "item_id").agg(F.min("date").alias("launch_date"))
                .select(F.concat_ws("|", "store_id", "item_id").alias("series_id"), "store_id", "category", "item_id", "launch_date"))

    def panel(self, level: str = "store_category", start: date | None = None, n_obs: int | None = None, daily: DataFrame | None = None) -> DataFrame:
        """Dense daily panel from each series' first day on; days without lines sold 0.  ``daily``: the observed days, if they are at hand."""
        if start is None:
            start, n_obs = self.window()
        daily = (self.daily(level) if daily is None else daily).withColumn("day_idx", F.datediff("date", F.lit(start)))
        dims = [c for c in ("store_id", "region", "category", "item_id") if c in daily.columns]
        out = fill_gaps(daily.drop("date"), n_obs - 1, by=["series_id", *dims],
                        fill={"y": 0.0, "disc": 0.0, "stockout": False})
        return out.withColumn("date", F.date_add(F.lit(start), F.col("day_idx")))

    def items(self) -> DataFrame:
        """Item dimension: price and pack size of the cheapest and smallest part."""
        return (self.table("part")
                .groupBy(F.concat_ws("|", "p_type", "p_brand").alias("item_id"), F.col("p_type").alias("category"))
                .agg(F.min("p_retailprice").alias("price"), F.min("p_size").alias("pack_size")))

    def categories(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_type").alias("category")).agg(
            F.min("p_retailprice").alias("price"), F.min("p_size").alias("pack_size"))

    def promotions(self, item: str = "p_type") -> DataFrame:
        """Per (item, region, month): a week from the first ship date at the best discount."""
        line = self.table("lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_shipdate")
        part, supplier = self.table("part"), self.table("supplier")
        shops = supplier.join(self.stores(), supplier.s_nationkey == F.col("n_nationkey"))
        return (line.join(part, line.l_partkey == part.p_partkey).join(shops, line.l_suppkey == shops.s_suppkey)
                .groupBy(F.col(item).alias("item_id"), "region", F.trunc("l_shipdate", "MM").alias("month"))
                .agg(F.min(F.to_date("l_shipdate")).alias("date_start"), F.max("l_discount").alias("discount"))
                .select("item_id", "region", "date_start", F.date_add("date_start", 6).alias("date_end"),
                        "discount", F.unix_date("month").alias("promo_ord")))

    @staticmethod
    def category_promotions(daily: DataFrame) -> DataFrame:
        """``promotions`` of the categories from the observed days of store x category series."""
        return (daily.groupBy(F.col("category").alias("item_id"), "region", F.trunc("date", "MM").alias("month"))
                .agg(F.min("date").alias("date_start"), F.max("disc").alias("discount"))
                .select("item_id", "region", "date_start", F.date_add("date_start", 6).alias("date_end"),
                        "discount", F.unix_date("month").alias("promo_ord")))

    def weather(self) -> DataFrame:
        """Per nation and order day: the covariates with real gaps on days without orders."""
        orders, customer = self.table("orders"), self.table("customer")
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("city"))
        return (orders.join(customer, orders.o_custkey == customer.c_custkey)
                .join(nation, customer.c_nationkey == nation.n_nationkey)
                .groupBy(F.to_date("o_orderdate").alias("date"), "city")
                .agg(F.floor(F.max("o_totalprice") / 10000.0).cast("double").alias("temp_max"),
                     F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("rain_mm"),
                     F.max(F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 5000.0).cast("double"))).alias("humidity")))

    def search(self) -> DataFrame:
        """Daily interest per event type."""
        return (self.table("events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("category"))
                .agg(F.max("value").alias("search_index")))

    # ------------------------------------------------------- assembled inputs
    def layout(self) -> Layout:
        return origin_layout(self.window()[1])

    def events_calendar(self) -> DataFrame:
        """Yearly events placed on the years that have orders: (date, event, kind, source, ev_ord)."""
        years = self.table("orders").select(F.year("o_orderdate").alias("yr")).distinct()
        rows = F.explode(F.array(*[
            F.struct(F.lit(n).alias("event"), F.lit(k).alias("kind"), F.lit(md).alias("md"), F.lit(i).alias("i"))
            for i, (n, k, md) in enumerate([("Spring Fair", "festival", "-04-12"), ("Founders Day", "public_holiday", "-04-14"),
                                            ("Year End", "festival", "-12-28"), ("Founders Day", "festival", "-04-14")])]))
        return years.withColumn("e", rows).select(
            F.to_date(F.concat(F.col("yr").cast("string"), F.col("e.md"))).alias("date"), "e.event", "e.kind",
            F.lit("stand-in").alias("source"), (F.col("yr") * 10 + F.col("e.i")).alias("ev_ord"))

    def event_days(self, start: date, n_obs: int, horizon: int = 14) -> DataFrame:
        meta = self.spark.createDataFrame(EVENT_META, "event string, span_days int, buildup_days int")
        spine = panel.calendar_spine(self.spark, start, n_obs, horizon)
        last = date.fromordinal(start.toordinal() + n_obs + horizon - 1)
        cal = panel.prepare_events(self.events_calendar(), meta, start, last)
        ids = F.array_position(F.array(*[F.lit(n) for n in sorted(m[0] for m in EVENT_META)]), F.col("event")).cast("int") - 1
        return panel.event_days(spine, cal.withColumn("event_id", ids), start)

    def weather_days(self, start: date) -> DataFrame:
        values = ["temp_max", "rain_mm", "humidity"]
        days = cut(self.weather())          # read for each city and for all of them
        return panel.with_all_entity(days.withColumn("day_idx", F.datediff("date", F.lit(start))), "city", values)

    def search_days(self, n_obs: int) -> DataFrame:
        """Event-log interest with its last day moved to the panel's last day; rows before the panel's first day go."""
        search = cut(self.search())         # read for its range, for each category and for all of them
        first, last = search.agg(F.min("date"), F.max("date")).first()
        rows = panel.search_panel(search, first).withColumn("day_idx", F.col("day_idx") + (n_obs - 1 - (last - first).days)).where(F.col("day_idx") >= 0)
        return fill_gaps(rows, n_obs - 1, by=["category"], fill={"search_index": None})

    def category_series(self, start: date, daily: DataFrame | None = None) -> DataFrame:
        """Store x category series with attributes, codes and covariate keys.  ``daily``: the observed days, if they are at hand."""
        daily = self.daily("store_category") if daily is None else daily
        dims = cut(daily.groupBy("series_id", "store_id", "region", "category").agg(
            F.datediff(F.min("date"), F.lit(start)).alias("launch_idx")).join(self.categories(), "category"))       # read by each code
        key = F.create_map(*[x for kv in SEARCH_KEYS.items() for x in map(F.lit, kv)])[F.col("category")]
        for c, out in (("category", "cat_idx"), ("store_id", "store_idx"), ("region", "region_idx")):
            dims = dims.join(panel.code_of(dims, c, out), c)
        return dims.withColumn("city", F.col("store_id")).withColumn("item_id", F.col("category")).withColumn(
            "search_key", F.coalesce(key, F.lit(panel.ALL)))

    def inputs(self, seed: int = 7) -> tuple[Inputs, Layout]:
        """Everything the feature builder reads, for store x category series.

        Orders, events and line items are read here and not again: line items are joined and grouped by day once, panel,
        series and promotions come from that table, and what a feature join reads is a written table of days, not a plan.
        """
        start, n_obs = self.window()
        lay = origin_layout(n_obs)
        last = n_obs - 1 + lay.horizon
        daily = cut(self.daily("store_category"))
        promos = cut(self.category_promotions(daily))
        active = cut(panel.promotion_days(promos, start, last))
        weather = cut(self.weather_days(start))
        return Inputs(
            panel=self.panel("store_category", start, n_obs, daily).persist(), series=cut(self.category_series(start, daily)), start=start, n_obs=n_obs,
            events=cut(self.event_days(start, n_obs, lay.horizon)), promo=active,
            post_promo=cut(panel.post_promotion_days(promos, active, start, last)), weather=weather,
            climate=cut(history.climatology(weather, lay.train_end, start=start)), search=cut(self.search_days(n_obs)), seed=seed), lay
