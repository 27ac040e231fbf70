"""Cold start: analog items, launch ramp, category mean.

Analogs are exact nearest neighbours on standardised (log price, log pack size + 1)
inside one store and category.  They are found through a cell grid, not by pairing a
group with itself: a store-category may hold any share of all series.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.functions.numeric import clip
from demandsense.operators.order_stats import group_median

# Analog count, days an analog must be on sale, ramp buckets and fallback.
K_ANALOGS, ESTABLISHED_DAYS, YOUNG_AGE, RAMP_DAYS = 5, 90, 28, 7
GENERIC_RAMP = [0.35, 0.6, 0.75, 0.85]
RAMP_CLIP, MIN_LAUNCHES = (0.05, 3.0), 3
LEVELS, DEEPEST = 12, 40   # cell sizes 1, 1/2, ... 1/2^12 of the attribute range; below that where cells are crowded, to the precision of coordinates
CROWD = 64                 # sites that a cell may hold without being parted further
GROUP = ["store_id", "category"]


def standardised(series: DataFrame) -> DataFrame:
    """series_id, group, launch_idx and grid coordinates u, v with their common scale.

    Coordinates are z-scores (population sd) shifted and scaled by one factor, so distances
    keep their order; ``unit`` turns a grid distance back.  The eight moments are read as
    one row, so every use of the coordinates sees the same numbers.
    """
    logs = series.select("series_id", *GROUP, "launch_idx", F.log("price").alias("a"),
                         F.log(F.col("pack_size") + 1.0).alias("b"))
    st = logs.agg(*[e.alias(f"{c}_{n}") for c in "ab" for n, e in (
        ("sd", F.stddev_pop(c)), ("lo", F.min(c)), ("hi", F.max(c)))]).first()
    sd = {c: (st[f"{c}_sd"] or 0.0) + 1e-9 for c in "ab"}
    lo = {c: st[f"{c}_lo"] or 0.0 for c in "ab"}
    unit = max(*[((st[f"{c}_hi"] or 0.0) - lo[c]) / sd[c] for c in "ab"], 1e-9) * (1 + 1e-9)
    u, v = (F.round((F.col(c) - lo[c]) / (sd[c] * unit), 12) for c in "ab")
    return logs.select("series_id", *GROUP, "launch_idx", u.alias("u"), v.alias("v"), F.lit(unit).alias("unit"))


def _cells(df: DataFrame, level) -> DataFrame:
    scale = F.pow(F.lit(2.0), level)
    return df.withColumn("cx", F.floor(F.col("u") * scale)).withColumn("cy", F.floor(F.col("v") * scale))


def _near() -> Column:
    """The steps to a cell and its eight neighbours."""
    one = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.transform(one, lambda x: F.transform(one, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def cell_grid(points: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, queries) in cells (``lv``, ``cx``, ``cy``) of every level they are needed on.

    All are on the first levels.  Cells that are still crowded on the last of those (an outlying point
    may squeeze all others into a few) are parted further: the points of a crowded cell and of its neighbours go
    on to the next levels, as do the queries inside it, so that whatever level a query is answered on, the cells around it
    are complete.  Points at equal coordinates cannot be parted; there are at most ``k + 1`` of them a launch day.
    """
    grids, probes, top, crowd = [], [], -1, None
    while True:
        low, top = top + 1, min(top + LEVELS + (top < 0), DEEPEST)
        levels = F.explode(F.sequence(F.lit(low), F.lit(top))).alias("lv")
        grids.append(_cells(points.select("*", levels), F.col("lv")))
        probes.append(_cells(asked.select("*", levels), F.col("lv")))
        if top == DEEPEST:
            break
        cells = _cells(points, F.lit(top)).groupBy(*GROUP, "cx", "cy").agg(F.count_distinct("u", "v").alias("sites")).where(F.col("sites") > CROWD).drop("sites")
        if crowd is not None:  # only there all points are at hand
            span = 2.0 ** (top - low + 1)
            above = cells.withColumns({"ax": F.floor(F.col("cx") / span), "ay": F.floor(F.col("cy") / span)})
            cells = above.join(crowd.withColumnsRenamed({"cx": "ax", "cy": "ay"}), [*GROUP, "ax", "ay"], "left_semi").select(*GROUP, "cx", "cy")
        crowd = cut(cells)
        if crowd.isEmpty():
            break
        around = crowd.withColumn("n", F.explode(_near())).select(*GROUP, (F.col("cx") + F.col("n.x")).alias("cx"), (F.col("cy") + F.col("n.y")).alias("cy")).distinct()
        points = cut(_cells(points, F.lit(top)).join(around, [*GROUP, "cx", "cy"], "left_semi").drop("cx", "cy"))
        asked = cut(_cells(asked, F.lit(top)).join(crowd, [*GROUP, "cx", "cy"], "left_semi").drop("cx", "cy"))
    return reduce(DataFrame.unionByName, grids), reduce(DataFrame.unionByName, probes)


def nearest_established(points: DataFrame, queries: DataFrame, k: int = K_ANALOGS) -> DataFrame:
    """(query columns..., analog, rank, distance): the ``k`` nearest other series of the
    same store and category launched on or before ``ready_by``; ties go to the lower id.

    ``points`` comes from ``standardised``; ``queries`` adds ``ready_by``.  Steps, all
    equi-joins and partial aggregations:

    1. points at equal coordinates and launch day keep their ``k + 1`` lowest ids (no other
       can be among the nearest), queries at equal coordinates and day are asked once;
    2. counts per (cell, launch day) give, for each query, the finest cell around it that
       holds more than ``k`` ready points; crowded cells have finer ones (``cell_grid``);
    3. its neighbours then lie in the 3 x 3 cells of twice that size; queries with too few
       ready points in the whole group read the group's earliest launches instead.
    """
    want = k + 1                                              # room for the query itself
    site = Window.partitionBy(*GROUP, "u", "v", "launch_idx").orderBy("series_id")
    pts = (points.select("series_id", *GROUP, "launch_idx", "u", "v")
           .withColumn("__rn", F.row_number().over(site)).where(F.col("__rn") <= want).drop("__rn"))
    pts = cut(pts)
    queries = cut(queries)
    asked = queries.select(*GROUP, "u", "v", "ready_by").distinct()

    grid, probes = cell_grid(pts, asked)
    stock = grid.groupBy(*GROUP, "lv", "cx", "cy", F.col("launch_idx").alias("at")).agg(F.count(F.lit(1)).alias("c"))
    marks = probes.select(*GROUP, "lv", "cx", "cy", F.col("ready_by").alias("at")).distinct().withColumn("c", F.lit(None).cast("bigint"))
    cell = Window.partitionBy(*GROUP, "lv", "cx", "cy").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    ready = (stock.unionByName(marks).withColumn("ready", F.sum("c").over(cell)).where("c IS NULL")
             .withColumnRenamed("at", "ready_by").drop("c"))
    sized = (probes.join(ready, [*GROUP, "lv", "cx", "cy", "ready_by"], "left")
             .groupBy(*GROUP, "u", "v", "ready_by")
             .agg(F.max(F.when(F.col("ready") >= want, F.col("lv"))).alias("fine")))
    sized = cut(sized)

    search = sized.where("fine IS NOT NULL").withColumn("lv", F.greatest(F.col("fine") - 1, F.lit(0)))
    search = _cells(search, F.col("lv")).withColumn("n", F.explode(_near()))
    search = search.select(*GROUP, "u", "v", "ready_by", "lv", (F.col("cx") + F.col("n.x")).alias("cx"), (F.col("cy") + F.col("n.y")).alias("cy"))
    right = grid.select(*GROUP, "lv", "cx", "cy", "launch_idx", F.col("series_id").alias("analog"), F.col("u").alias("pu"), F.col("v").alias("pv"))
    dense = search.join(right, [*GROUP, "lv", "cx", "cy"]).where("launch_idx <= ready_by")

    early = Window.partitionBy(*GROUP).orderBy("launch_idx", "series_id")
    earliest = pts.withColumn("__rn", F.row_number().over(early)).where(F.col("__rn") <= want).select(
        *GROUP, "launch_idx", F.col("series_id").alias("analog"), F.col("u").alias("pu"), F.col("v").alias("pv"))
    sparse = sized.where("fine IS NULL").join(earliest, GROUP).where("launch_idx <= ready_by")

    cols = [*GROUP, "u", "v", "ready_by", "analog", "pu", "pv"]
    found = dense.select(*cols).unionByName(sparse.select(*cols))
    found = found.withColumn("gap", F.round(F.hypot(F.col("u") - F.col("pu"), F.col("v") - F.col("pv")), 9))
    best = Window.partitionBy(*GROUP, "u", "v", "ready_by").orderBy("gap", "analog")
    found = found.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= want).drop("pu", "pv", "__rn")
    mine = queries.join(found, [*GROUP, "u", "v", "ready_by"]).where(F.col("analog") != F.col("series_id"))
    own = Window.partitionBy(*[c for c in queries.columns if c not in ("u", "v", "unit")]).orderBy("gap", "analog")
    ranked = mine.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select(*[c for c in queries.columns if c not in ("u", "v", "unit", "ready_by")], "ready_by", "analog", "rank",
                         (F.col("gap") * F.col("unit")).alias("distance"))


def analog_table(series: DataFrame, k: int = K_ANALOGS) -> DataFrame:
    """(series_id, analog, rank, distance) over all other series of the group."""
    pts = standardised(series)
    return nearest_established(pts, pts.withColumn("ready_by", F.lit(2**30)), k).select("series_id", "analog", "rank", "distance")


def launch_ramp(panel: DataFrame, series: DataFrame, upto: int, k: int = K_ANALOGS) -> DataFrame:
    """(bucket, launches, ramp): new-item sales relative to the median of its analogs, per
    7-day age bucket, over launches whose first 28 days ended by ``upto``."""
    pts = standardised(series)
    launched = pts.where((F.col("launch_idx") > 0) & (F.col("launch_idx") + YOUNG_AGE <= upto))
    pairs = nearest_established(pts, launched.withColumn("ready_by", F.col("launch_idx") - ESTABLISHED_DAYS), k)
    pairs = cut(pairs.select("series_id", F.col("launch_idx").alias("begin"), F.col("analog").alias("member")))
    own = pairs.select("series_id", "begin", F.col("series_id").alias("member")).distinct()
    every = pairs.unionByName(own)
    # weekly sales of each (member, launch day) once, however many launches share it
    spans = every.select("member", "begin").distinct()
    weekly = (spans.join(panel.select(F.col("series_id").alias("member"), "day_idx", "y"), "member")
              .where(F.col("day_idx").between(F.col("begin"), F.col("begin") + YOUNG_AGE - 1))
              .groupBy("member", "begin", F.floor((F.col("day_idx") - F.col("begin")) / RAMP_DAYS).cast("int").alias("bucket"))
              .agg(F.sum("y").alias("units")))
    buckets = F.explode(F.sequence(F.lit(0), F.lit(len(GENERIC_RAMP) - 1))).alias("bucket")
    rows = (every.select("*", buckets).join(weekly, ["member", "begin", "bucket"], "left")
            .withColumn("units", F.coalesce("units", F.lit(0.0))))
    mine = F.col("member") == F.col("series_id")
    ratios = rows.groupBy("series_id", "bucket").agg(
        F.percentile(F.when(~mine, F.col("units")), F.lit(0.5)).alias("den"), F.max(F.when(mine, F.col("units"))).alias("num"))
    ratios = cut(ratios.where("den > 0").withColumn("r", F.col("num") / F.col("den")))
    medians = (ratios.groupBy("bucket").agg(F.count(F.lit(1)).alias("launches"))
               .join(group_median(ratios, ["bucket"], "r", "m"), "bucket"))
    generic = series.sparkSession.createDataFrame(list(enumerate(GENERIC_RAMP)), "bucket int, generic double")
    return generic.join(medians, "bucket", "left").select(
        "bucket", F.coalesce("launches", F.lit(0)).alias("launches"),
        clip(F.when(F.col("launches") >= MIN_LAUNCHES, F.col("m")).otherwise(F.col("generic")), *RAMP_CLIP).alias("ramp"))


def analog_forecast(rows: DataFrame, series: DataFrame, ramp: DataFrame, point: str = "final", k: int = K_ANALOGS,
                    young_age: int = YOUNG_AGE) -> DataFrame:
    """Add ``c1``: on young rows the median of the analogs' forecast for the same origin and
    day times the ramp of the age week (0 without analogs); other rows keep ``point``."""
    young = rows.where(F.col("age") < young_age).select("series_id", "origin", "day", "age")
    starts = young.select("series_id", "origin").distinct()
    pts = standardised(series)
    asked = pts.join(starts, "series_id").withColumn("ready_by", F.col("origin") - ESTABLISHED_DAYS)
    pairs = nearest_established(pts, asked, k).select("series_id", "origin", "analog")
    ref = rows.select(F.col("series_id").alias("analog"), "origin", "day", F.col(point).alias("__f"))
    base = (pairs.join(ref, ["analog", "origin"]).groupBy("series_id", "origin", "day")
            .agg(F.percentile("__f", F.lit(0.5)).alias("__base")))
    week = F.least(F.floor(F.col("age") / RAMP_DAYS), F.lit(len(GENERIC_RAMP) - 1)).cast("int")
    by_week = ramp.select(F.col("bucket").alias("__week"), F.col("ramp").alias("__ramp"))
    out = (rows.join(base, ["series_id", "origin", "day"], "left").withColumn("__week", week)
               .join(F.broadcast(by_week), "__week", "left"))         # a row for each week of the ramp
    c1 = F.when(F.col("age") < young_age, F.coalesce("__base", F.lit(0.0)) * F.col("__ramp")).otherwise(F.col(point))
    return out.select(*rows.columns, c1.alias("c1"))


def category_mean(rows: DataFrame, stats: DataFrame, point: str = "final", young_age: int = YOUNG_AGE) -> DataFrame:
    """Add ``catmean``: on young rows the mean of mean28 at the origin over established
    series of the store and category (0 if none); other rows keep ``point``.

    ``stats``: series_id, store_id, category, launch_idx, origin, mean28."""
    est = stats.where(F.col("launch_idx") + ESTABLISHED_DAYS <= F.col("origin"))
    mean = est.groupBy(*GROUP, "origin").agg(F.avg("mean28").alias("__cm"))
    out = rows.join(mean, [*GROUP, "origin"], "left")
    cm = F.when(F.col("age") < young_age, F.coalesce("__cm", F.lit(0.0))).otherwise(F.col(point))
    return out.select(*rows.columns, cm.alias("catmean"))


