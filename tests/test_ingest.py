"""The ingest plan on a small folder of raw feeds."""
import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from demandsense.operators import contracts, decisions
from demandsense.plans import increment, orders
from demandsense.plans.ingest import ingest
from demandsense.sources import feeds


def _write(spark, raw, extra_item=""):
    raw.mkdir()
    (raw / "stores.csv").write_text("store_id,city,region\nS01,Pune,West\n")
    (raw / "items.csv").write_text("item_id,category,price,pack_size,launch_date\nI001,snacks,10.0,6,2025-01-01\n" + extra_item)
    (raw / "events.csv").write_text("date,event,kind,source,span_days,buildup_days\n2025-01-02,Fair,festival,hand,2,1\n")
    (raw / "promotions.csv").write_text("item_id,region,date_start,date_end,discount\nI001,West,2025-01-02,2025-01-03,0.2\n")
    (raw / "search.csv").write_text("date,category,search_index\n2025-01-01,snacks,40.0\n")
    d = dt.date(2025, 1, 1)
    wx = "date date, city string, temp_max double, rain_mm double, humidity double"
    spark.createDataFrame([(d, "Pune", None, 1.0, 50.0)], wx).coalesce(1).write.parquet(str(raw / "weather.parquet"))
    spark.createDataFrame([(d, "Pune", 30.0, 1.0, 50.0)], wx).coalesce(1).write.parquet(str(raw / "weather_forecast.parquet"))
    rows = [(d, "S01", "I001", 5, 10.0, 5, 0, 0), (d, "S01", "I001", 6, 10.0, 6, 0, 0), (d, "S01", "I009", 1, 10.0, 2, 0, 1), (d, "S01", "X", 1, 10.0, 2, 0, 1)]
    spark.createDataFrame(rows, "date date, store_id string, item_id string, units_sold bigint, unit_price double, on_hand_open bigint, receipts bigint,"
                                " on_hand_close bigint").coalesce(1).write.parquet(str(raw / "sales.parquet"))


def test_ingest(spark, tmp_path):
    _write(spark, tmp_path / "raw")
    report = {(r["metric"], r["key"]): r["value"] for r in ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"), dt.date(2025, 2, 1)).collect()}
    assert report["rows_raw", ""] == "4" and report["rows_clean", ""] == "1" and report["weather_rows_missing", ""] == "1"
    assert {k for m, k in report if m == "quarantine_reason"} == {"duplicate_key", "unknown_key", "schema"}
    clean = spark.read.parquet(str(tmp_path / "out/processed/sales")).collect()
    assert [(r["units_sold"], r["stockout"]) for r in clean] == [(5, True)]


def test_broken_dimension_fails(spark, tmp_path):
    _write(spark, tmp_path / "raw", "I002,toys,1.0,1,2025-01-01\n")
    with pytest.raises(ValueError, match="items"):
        ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"), dt.date(2025, 2, 1))


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert feeds.table_fingerprint(a).first() == feeds.table_fingerprint(a.orderBy(F.col("id").desc())).first()


# ------------------------------------------------------------------ report of a write
def test_observed_report_equals_the_scanned_one(spark, tmp_path):
    rows = [(dt.date(2025, 1, d), close, reason) for d, close, reason in [(1, 0, None), (2, 3, None), (3, 0, "schema"), (4, 1, "bad_price"), (5, 0, "schema")]]
    marked = spark.createDataFrame(rows, "date date, on_hand_close bigint, reason string").repartition(2)
    got = contracts.observed_report(marked, lambda df: df.write.parquet(str(tmp_path / "a")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, contracts.quality_report(marked).collect()))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5
    void = contracts.observed_report(marked.where("reason = 'schema'"), lambda df: df.write.parquet(str(tmp_path / "b")))
    assert {r.metric: r.value for r in void.collect()}["first_date"] is None
    with pytest.raises(ValueError):
        contracts.observed_report(marked, lambda df: df.write.parquet(str(tmp_path / "c")), ["schema"])
    empty = {r.metric: r.value for r in contracts.observed_report(marked.limit(0), lambda df: df.write.parquet(str(tmp_path / "d"))).collect()}
    assert empty["rows_raw"] == "0" and "quarantine_reason" not in empty


# ------------------------------------------------------------------ decisions that arrive as files
DECISION = "id long, store_id string, item_id string, order_date string, action string, final_qty bigint, reason_code string, note string, ts string, user_name string"


def _decision(i, action="approve", qty=5, ts="2025-01-01 10:00:00", item="I001"):
    return (i, "S01", item, "2025-01-02", action, qty, "promo" if action != "approve" else None, " n ", ts, "u")


def test_decision_stream_takes_each_decision_once(spark, tmp_path):
    wanted = spark.createDataFrame([("S01", "I001", "2025-01-02", 7)], "store_id string, item_id string, order_date string, suggested_qty bigint")
    rules, incoming, log, state = decisions.decision_rules(["promo"]), str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")

    def arrive(rows):
        spark.createDataFrame(rows, DECISION).coalesce(1).write.mode("append").parquet(incoming)

    def run():
        orders.append_stream(spark, incoming, spark.createDataFrame([], DECISION).schema, wanted, rules, log, state, "m2")
        return sorted(((r.id, r.final_qty, r.reason) for r in spark.read.parquet(log).collect()), key=key)
    key = lambda r: (r[0], r[2] or "", r[1] or 0)
    arrive([_decision(1), _decision(2, "override", 9), _decision(2, "override", 11, "2025-01-01 09:00:00"), _decision(3, item="I009"), _decision(4, "reject")])
    first = run()
    assert first == sorted([(1, 7, None), (2, 11, None), (2, None, "repeated_id"), (3, None, "unknown_item"), (4, 0, None)], key=key)
    assert run() == first  # nothing new
    arrive([_decision(1), _decision(5)])
    second = run()
    assert sorted(set(second) - set(first), key=key) == [(1, None, "repeated_id"), (5, 7, None)] and len(second) == len(first) + 2
    assert sorted(r.id for r in orders.decision_log(spark, log).collect()) == [1, 2, 4, 5]
    # the last batch once more, as after a crash between its write and its commit
    again = spark.createDataFrame([_decision(1), _decision(5)], DECISION)
    last = spark.read.parquet(log).agg(F.max("batch")).first()[0]
    orders.append_batch(again, last, wanted, rules, log, "m2")
    spark.catalog.refreshByPath(log)
    assert sorted(((r.id, r.final_qty, r.reason) for r in spark.read.parquet(log).collect()), key=key) == second


# ------------------------------------------------------------------ changed files
def test_only_changed_files_are_read(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    (raw / "deep").mkdir(parents=True)
    asked = []

    def put(name, values):
        pq.write_table(pa.table({"k": pa.array(values, pa.int64()), "x": pa.array([v / 2 for v in values])}), raw / name)

    def sync():
        def read(paths):
            asked.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
            return feeds.read_parquet_feed(spark, paths)
        return {r.path.rsplit("/", 1)[-1]: r.state for r in increment.sync(spark, str(raw), out, read).collect()}

    def same():
        whole = spark.read.option("recursiveFileLookup", True).parquet(str(raw))
        return feeds.table_fingerprint(increment.table(spark, out).select("k", "x")).first() == feeds.table_fingerprint(whole.select("k", "x")).first()
    assert sync() == {} and asked == []
    put("a.parquet", [1, 2, 2])
    put("b.parquet", [3])
    put("deep/c.parquet", [4, 5])
    assert sync() == {"a.parquet": "added", "b.parquet": "added", "c.parquet": "added"} and same()
    assert set(sync().values()) == {"same"} and len(asked) == 1 and same()
    put("b.parquet", [3, 30])
    (raw / "a.parquet").rename(raw / "d.parquet")
    assert sync() == {"a.parquet": "removed", "b.parquet": "changed", "c.parquet": "same", "d.parquet": "added"} and same()
    assert asked[-1] == ["b.parquet", "d.parquet"]
    assert increment.last_manifest(spark, out)[0] == 4 and increment.table(spark, out).count() == 7
