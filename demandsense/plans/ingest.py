"""Feeds in, trusted tables out: contracts, quarantine, referential check, report."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.operators import contracts as C
from demandsense.sources import feeds

DIMENSIONS = {"stores": C.stores_contract, "items": C.items_contract, "events": C.events_contract,
              "promotions": C.promotions_contract, "search": C.search_contract}


def annotate_sales(sales: DataFrame, items: DataFrame, stores: DataFrame, max_date, order: list[str],
                   gate=None) -> DataFrame:
    """Sales feed with the first broken rule per row, the schema gate and unknown keys."""
    contract = C.sales_contract(max_date)
    rows = C.annotate(sales, contract.rules, keys=contract.unique, order=order, gate=C.sales_schema_rules() if gate is None else gate)
    return C.with_stockout(C.flag_unknown_keys(rows, [(items, "item_id"), (stores, "store_id")]))


def ingest(spark: SparkSession, raw: str, out: str, max_date) -> DataFrame:
    """Run the ingest step over a folder of raw feeds; returns the quality report.

    The annotated feed is written once, partitioned by outcome, and the report is observed during that write; both sides
    read the written table, so the checks run once."""
    dims = {}
    for name, declared in DIMENSIONS.items():
        contract = declared()
        feed, broken = feeds.split_corrupt(feeds.read_csv_feed(spark, f"{raw}/{name}.csv", contract).cache())
        if not broken.isEmpty():
            raise ValueError(f"{name}: lines that do not parse")
        dims[name] = C.require_valid(feed, contract, name)
    dims["weather"] = C.require_valid(feeds.read_parquet_feed(spark, f"{raw}/weather.parquet"), C.weather_contract(), "weather")
    dims["weather_forecast"] = feeds.read_parquet_feed(spark, f"{raw}/weather_forecast.parquet")
    sales = feeds.with_ingest_order(feeds.read_parquet_feed(spark, f"{raw}/sales.parquet"))
    marked = annotate_sales(sales, dims["items"], dims["stores"], max_date, ["ingest_ord"]).drop("ingest_ord")
    sided = marked.withColumn("outcome", F.when(F.col("reason").isNull(), "clean").otherwise("quarantine"))
    report = C.observed_report(sided, lambda df: feeds.write_table(df, f"{out}/sales_checked", ["outcome"]))
    checked = spark.read.parquet(f"{out}/sales_checked")
    feeds.write_table(C.clean_rows(checked).drop("outcome"), f"{out}/processed/sales")
    feeds.write_table(C.quarantined_rows(checked).drop("outcome"), f"{out}/quarantine/sales")
    for name, df in dims.items():
        feeds.write_table(df, f"{out}/processed/{name}")
    report = report.unionByName(
        C.missing_weather_rows(dims["weather"]).select(F.lit("weather_rows_missing").alias("metric"), F.lit("").alias("key"),
                                                       F.col("rows_missing").cast("string").alias("value")))
    feeds.write_metrics(report, f"{out}/report")
    feeds.write_table(feeds.file_manifest(spark, raw), f"{out}/manifest")
    return report
