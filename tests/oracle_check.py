"""Run registered queries in Spark and their SQL in DuckDB and compare every value.

python tests/oracle_check.py [--sf 0.01] [name ...]
"""
from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _sorted(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in r))


def compare(spark_df, rel) -> str:
    """'' when equal, else what differs."""
    sc, srows = _sorted(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cols = [d[0] for d in rel.description]
    dc, drows = _sorted(cols, rel.fetchall())
    if sc != dc:
        return f"columns {set(sc) ^ set(dc)}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} vs {len(drows)}"
    if srows == drows:
        return ""
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    where = {sc[i] for a, b in bad for i in range(len(sc)) if a[i] != b[i]}
    a, b = bad[0]
    first = [(sc[i], a[i], b[i]) for i in range(len(sc)) if a[i] != b[i]]
    return f"{len(bad)} of {len(srows)} rows differ in {sorted(where)}; first {first} in {a}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, sql = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                t1 = time.time()
                rel = con.execute(sql[name])
                t2 = time.time()
                msg = compare(df, rel)
                msg = msg or "ok"
                extra = f"sql {t2 - t1:.1f}s"
            else:
                msg, extra = f"rows only: {df.count()}", ""
        except Exception as e:  # noqa: BLE001
            msg, extra = f"ERROR {type(e).__name__}: {str(e)[:1500]}", ""
        failed += msg.startswith("ERROR") or not (msg == "ok" or msg.startswith("rows only"))
        print(f"{name:32s} {time.time() - t0:6.1f}s {extra} {msg}", flush=True)
        spark.catalog.clearCache()
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
