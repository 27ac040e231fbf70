"""Daily panel: series dimension, day spine, gap filling, covariates by day.

The panel is a long table, one row per (series, day).  All work that grows with the
data is keyed by series; day-level tables (events, weather, search) have at most one
row per day and entity.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandsense.functions.numeric import clip

ALL = "__all__"


def day_index(c: Column | str, start: date) -> Column:
    return F.datediff(c, F.lit(start))


def calendar_spine(spark: SparkSession, start: date, n_obs: int, horizon: int) -> DataFrame:
    """One row per day from ``start`` to ``horizon`` days past the last observed day."""
    return (spark.range(n_obs + horizon)
            .select(F.col("id").cast("int").alias("day_idx"),
                    F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"),
                    (F.col("id") < n_obs).alias("observed")))


def code_of(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a low-cardinality dimension column with 0-based sorted codes."""
    distinct = df.select(column).distinct()
    return distinct.withColumn(out, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))


def series_dimension(stores: DataFrame, items: DataFrame, start: date) -> DataFrame:
    """Every store carries every item: the dimension *is* the product of the two small
    dimension tables (stores x items rows), with integer codes and launch index."""
    coded = (stores.join(code_of(stores, "store_id", "store_idx"), "store_id")
                   .join(code_of(stores, "region", "region_idx"), "region"))
    items = items.join(code_of(items, "category", "cat_idx"), "category")
    return (items.crossJoin(coded)
            .withColumn("launch_idx", F.greatest(F.lit(0), day_index("launch_date", start)))
            .withColumn("level", F.lit("item_store"))
            .withColumn("node_id", F.concat_ws("|", "store_id", "item_id")))


def fill_gaps(daily: DataFrame, last_day: int, *, by: list[str], fill: dict[str, object]) -> DataFrame:
    """Dense rows from each series' first row to ``last_day`` without a join.

    Each row is repeated up to the day before the series' next row; the repeats carry
    ``fill`` values.  One exchange on the series key; (series, day) must be unique,
    so a series has at most ``last_day + 1`` rows.
    """
    w = Window.partitionBy(by[0]).orderBy("day_idx")
    until = F.coalesce(F.lead("day_idx").over(w) - 1, F.lit(last_day))
    rest = [c for c in daily.columns if c not in {*by, *fill, "day_idx"}]
    grown = daily.withColumn("__until", until).select(
        *by, *rest, *fill, F.col("day_idx").alias("__day"),
        F.explode(F.sequence("day_idx", F.greatest("day_idx", F.col("__until")))).alias("day_idx"))
    own = F.col("day_idx") == F.col("__day")
    return grown.select(*by, "day_idx", *rest,
                        *[F.when(own, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in fill.items()])


def dense_panel(series: DataFrame, sales: DataFrame, last_day: int) -> DataFrame:
    """(series, day) grid from launch to ``last_day``: missing days have NULL ``y`` and
    are not stockouts.  ``sales``: (series_id, day_idx, y, stockout), unique per day."""
    joined = series.select("series_id", "launch_idx").join(
        sales.select("series_id", "day_idx", "y", "stockout"), "series_id", "left")
    w = Window.partitionBy("series_id").orderBy("day_idx")
    first = F.lag("day_idx").over(w).isNull()
    start = F.when(first, F.least("launch_idx", F.coalesce("day_idx", "launch_idx"))).otherwise(F.col("day_idx"))
    until = F.coalesce(F.lead("day_idx").over(w) - 1, F.lit(last_day))
    spans = joined.withColumn("__from", start).withColumn("__to", until).where("__from <= __to")
    grown = spans.select("series_id", F.col("day_idx").alias("__day"), "y", "stockout",
                         F.explode(F.sequence("__from", "__to")).alias("day_idx"))
    own = F.col("__day") == F.col("day_idx")
    return grown.select("series_id", "day_idx", F.when(own, F.col("y")).alias("y"),
                        F.coalesce(F.when(own, F.col("stockout")), F.lit(False)).alias("stockout"))


# ---------------------------------------------------------------- promotions
def promotion_days(promos: DataFrame, start: date, last_day: int) -> DataFrame:
    """(item_id, region, day_idx, disc): planned discount per day, clipped to the panel;
    where promotions overlap the later one in feed order (``promo_ord``) wins."""
    a = F.greatest(day_index("date_start", start), F.lit(0))
    b = F.least(day_index("date_end", start), F.lit(last_day))
    days = (promos.withColumn("__a", a).withColumn("__b", b).where("__a <= __b")
            .select("item_id", "region", "promo_ord", "discount", F.explode(F.sequence("__a", "__b")).alias("day_idx")))
    return (days.groupBy("item_id", "region", "day_idx")
            .agg(F.max_by("discount", F.struct("promo_ord", "discount")).alias("disc")))


def post_promotion_days(promos: DataFrame, active: DataFrame, start: date, last_day: int, span: int = 4) -> DataFrame:
    """(item_id, region, day_idx, post_promo): 1..span days after the nearest ended
    promotion, on days without an active discount."""
    end = day_index("date_end", start)
    after = (promos.where(end >= 0)
             .select("item_id", "region", end.alias("__end"), F.explode(F.sequence(F.lit(1), F.lit(span))).alias("j"))
             .withColumn("day_idx", F.col("__end") + F.col("j")).where(F.col("day_idx") <= last_day)
             .groupBy("item_id", "region", "day_idx").agg(F.min("j").alias("post_promo")))
    busy = active.where("disc > 0").select("item_id", "region", "day_idx")
    return after.join(busy, ["item_id", "region", "day_idx"], "left_anti")


def drop_overlapping_promotions(promos: DataFrame) -> DataFrame:
    """Per (item, region) in start order, drop a promotion that starts on or before the
    end of the last kept one.

    Only the first promotion in feed order of each start date can be kept, so rows are
    reduced to one per (item, region, start) with map-side combine; a group then holds at
    most one row per calendar day before the ordered fold runs over it.
    """
    firsts = (promos.groupBy("item_id", "region", "date_start")
              .agg(F.min_by(F.struct("date_end", "discount", "promo_ord"), "promo_ord").alias("p")))
    ordered = firsts.groupBy("item_id", "region").agg(
        F.array_sort(F.collect_list(F.struct("date_start", "p.date_end", "p.discount", "p.promo_ord"))).alias("ps"))
    kept_type = "array<struct<date_start:date,date_end:date,discount:double,promo_ord:bigint>>"
    start = F.struct(F.lit(None).cast("date").alias("last_end"), F.array().cast(kept_type).alias("kept"))

    def step(acc, p):
        take = acc["last_end"].isNull() | (p["date_start"] > acc["last_end"])
        row = F.struct(p["date_start"].alias("date_start"), p["date_end"].alias("date_end"),
                       p["discount"].cast("double").alias("discount"), p["promo_ord"].cast("bigint").alias("promo_ord"))
        return F.struct(F.when(take, p["date_end"]).otherwise(acc["last_end"]).alias("last_end"),
                        F.when(take, F.concat(acc["kept"], F.array(row))).otherwise(acc["kept"]).alias("kept"))

    folded = ordered.select("item_id", "region", F.explode(F.aggregate("ps", start, step)["kept"]).alias("p"))
    return folded.select("item_id", "region", "p.date_start", "p.date_end", "p.discount", "p.promo_ord")


# ------------------------------------------------------- weather and search
def observed_or_issued(observed: DataFrame, issued: DataFrame) -> DataFrame:
    """Observations win; an issued forecast fills dates with no observation at all."""
    return observed.unionByName(
        issued.join(observed.select("date").distinct(), "date", "left_anti"), allowMissingColumns=True)


def fill_from_secondary(primary: DataFrame, secondary: DataFrame, values: list[str],
                        keys: tuple[str, ...] = ("date", "city")) -> DataFrame:
    """Each missing value falls back to the secondary source; ``filled`` counts per row."""
    other = secondary.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    joined = primary.join(other, list(keys), "left")
    used = sum((F.col(v).isNull() & F.col(f"__{v}").isNotNull()).cast("int") for v in values)
    return joined.withColumn("filled", used).select(
        *keys, *[F.coalesce(v, f"__{v}").alias(v) for v in values], "filled")


def with_all_entity(df: DataFrame, entity: str, values: list[str], by: str = "day_idx") -> DataFrame:
    """Add, per day, a row for the mean over all entities (key ``__all__``)."""
    mean = df.groupBy(by).agg(*[F.avg(v).alias(v) for v in values]).withColumn(entity, F.lit(ALL))
    return df.select(by, entity, *values).unionByName(mean.select(by, entity, *values))


def search_panel(search: DataFrame, start: date) -> DataFrame:
    """(day_idx, category, search_index) clipped to 0..100 plus the all-category mean."""
    rows = search.select(day_index("date", start).alias("day_idx"), "category",
                         clip("search_index", 0, 100).alias("search_index"))
    return with_all_entity(rows, "category", ["search_index"])


def widen(df: DataFrame, index: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """Long to wide for export; the key list is declared so no extra job finds it."""
    return df.groupBy(index).pivot(key, keys).agg(F.first(value))


# --------------------------------------------------------------------- events
def prepare_events(events: DataFrame, meta: DataFrame, first: date, last: date, margin: int = 30) -> DataFrame:
    """One row per (date, event) within ``margin`` days of the range, with the span and
    build-up days of its kind of event."""
    near = events.where(F.col("date").between(F.date_sub(F.lit(first), margin), F.date_add(F.lit(last), margin)))
    unique = (near.groupBy("date", "event")
              .agg(F.min_by(F.struct("kind", "source", "ev_ord"), "ev_ord").alias("e"))
              .select("date", "event", "e.kind", "e.source", "e.ev_ord"))
    return unique.join(meta, "event", "left")


def event_days(spine: DataFrame, events: DataFrame, start: date, lead: int = 14, none: int = 99) -> DataFrame:
    """Per day: signed days to the nearest event (ties keep the earlier calendar row),
    its id, whether a festival runs and whether it is a public holiday.

    Each event is expanded to the days it can reach, so the lookup is an aggregate and an
    equi-join instead of a range join.
    """
    reach = (events.withColumn("__ev", day_index("date", start))
             .select("event_id", "kind", "span_days", "ev_ord", "__ev",
                     F.explode(F.sequence(-(F.col("span_days") - 1), F.lit(lead))).alias("delta"))
             .withColumn("day_idx", F.col("__ev") - F.col("delta")))
    nearest = reach.groupBy("day_idx").agg(
        F.min_by(F.struct("delta", "event_id"), F.struct(F.abs("delta"), "__ev", "ev_ord")).alias("n"),
        F.bool_or(F.col("delta") <= 0).alias("running"),
        F.bool_or((F.col("kind") == "public_holiday") & (F.col("delta") == 0)).alias("holiday"))
    return spine.join(nearest, "day_idx", "left").select(
        *spine.columns,
        F.coalesce("n.delta", F.lit(none)).alias("days_to_event"),
        F.coalesce("n.event_id", F.lit(-1)).alias("event_id"),
        F.coalesce(F.col("running").cast("int"), F.lit(0)).alias("in_festival"),
        F.coalesce(F.col("holiday").cast("int"), F.lit(0)).alias("is_holiday"))


def with_series_keys(df: DataFrame, series: DataFrame, start: date, keys: list[str]) -> DataFrame:
    """Add series attributes, target date and origin date."""
    return (df.join(series.select("series_id", *keys), "series_id")
              .withColumn("date", F.date_add(F.lit(start), F.col("day")))
              .withColumn("origin_date", F.date_add(F.lit(start), F.col("origin"))))
