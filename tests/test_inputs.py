"""What the feature builder reads: the same rows as the plain views, from tables written once."""
from dataclasses import replace

from pyspark.sql import functions as F

from demandsense.plans import catalogue
from demandsense.sources.star import Star

PATH = "/root/testdata/sf0.001"


def test_inputs_do_not_read_the_large_tables_again(spark):
    inp, _ = Star(spark, PATH).inputs()
    for name in ("panel", "series", "events", "promo", "post_promo", "weather", "climate", "search"):
        files = getattr(inp, name).inputFiles()
        assert not [f for f in files if f.endswith(("lineitem.parquet", "orders.parquet", "events.parquet"))], name


def test_category_promotions_are_the_promotions(spark):
    star = Star(spark, PATH)
    plain, made = star.promotions(), star.category_promotions(star.daily())
    assert made.columns == plain.columns and made.count() == plain.count() > 0
    assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()


def test_daily_at_hand_gives_the_same_panel_and_series(spark):
    star = Star(spark, PATH)
    start, n = star.window()
    daily = star.daily()
    for plain, made in ((star.panel("store_category", start, n), star.panel("store_category", start, n, daily)), (star.category_series(start), star.category_series(start, daily))):
        assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()


def test_launches_are_the_first_days(spark):
    star = Star(spark, PATH)
    made, daily = star.launches(), star.daily("item_store")
    plain = daily.groupBy("series_id", "store_id", "category", "item_id").agg(F.min("date").alias("launch_date"))
    assert made.columns == plain.columns and made.count() == plain.count() > 0
    assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()


def test_item_series_do_not_come_from_the_days_of_all_series(spark):
    spark.catalog.clearCache()
    _, series, *_ = catalogue._cold(Star(spark, PATH))
    plan = series._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    assert "l_shipdate" in plan and "l_quantity" not in plan


def test_gates_read_the_inputs_at_hand(spark):
    star = Star(spark, PATH)
    inp, lay = star.inputs()
    rows = inp.series.select("store_id", "category", "region").withColumn("day", F.explode(F.sequence(F.lit(inp.n_obs - 200), F.lit(inp.n_obs + 5))))
    made = catalogue._with_day_type(star, rows, inp, lay)
    plain = catalogue._with_day_type(star, rows, replace(inp, events=None, promo=None, weather=None), lay)
    assert not [f for f in made.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]
    assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()
    assert not [f for f in catalogue._ledger(star, inp).inputFiles() if f.endswith("lineitem.parquet")]
