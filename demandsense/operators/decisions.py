"""Order review and decisions as batch queries over served tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.numeric import finite
from demandsense.operators.contracts import ACTIONS, ITEM_PATTERN, STORE_PATTERN, Rule, first_reason, missing, unmatched

# Limits of a decision and the labels of the driver columns.
MAX_QTY, MAX_NOTE = 100_000, 280
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
GUARD_FACTOR, GUARD_FLOOR = 10, 50


def decision_rules(reason_codes: Sequence[str], store_pattern: str = STORE_PATTERN, item_pattern: str = ITEM_PATTERN) -> list[Rule]:
    known = F.col("reason_code").isin(list(reason_codes))
    return [("store_id", missing("store_id") | unmatched("store_id", store_pattern)),
            ("item_id", missing("item_id") | unmatched("item_id", item_pattern)),
            ("order_date", missing("order_date") | unmatched("order_date", DATE_PATTERN)),
            ("action", missing("action") | ~F.col("action").isin(ACTIONS)),
            ("final_qty", missing("final_qty") | ~F.col("final_qty").between(0, MAX_QTY)),
            ("note_length", F.length("note") > MAX_NOTE),
            ("reason_required", F.col("action").isin("override", "reject") & (missing("reason_code") | ~known)),
            ("reason_unknown", F.col("reason_code").isNotNull() & ~known)]


def validate_decisions(decisions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``reason`` (first broken rule) and trim the note."""
    return decisions.withColumn("reason", first_reason(rules)).withColumn("note", F.trim("note"))


def guard_decisions(decisions: DataFrame, orders: DataFrame) -> DataFrame:
    """Check valid decisions against the suggested orders: unknown item, other order date,
    or a quantity above the guard get a ``reason``; the rest get their final quantity."""
    o = orders.select("store_id", "item_id", F.col("order_date").alias("__date"), F.col("suggested_qty").alias("__suggested"))
    rows = decisions.join(o, ["store_id", "item_id"], "left")
    final = F.when(F.col("action") == "approve", F.col("__suggested")).when(F.col("action") == "reject", 0).otherwise(F.col("final_qty"))
    guard = F.greatest(GUARD_FACTOR * F.col("__suggested"), F.lit(GUARD_FLOOR))
    own = first_reason([("unknown_item", F.col("__suggested").isNull()), ("order_date_conflict", F.col("__date") != F.col("order_date")),
                        ("above_guard", final > guard)])
    reason = F.coalesce(F.col("reason"), own) if "reason" in decisions.columns else own
    rows = rows.withColumn("reason", reason)
    return rows.select(*[c for c in decisions.columns if c not in ("reason", "final_qty")], F.col("__suggested").alias("suggested_qty"),
                       F.when(F.col("reason").isNull(), final).alias("final_qty"), "reason")


def accepted(guarded: DataFrame, model_version: str) -> DataFrame:
    """Rows for the decision log."""
    return guarded.where("reason IS NULL").drop("reason").withColumn("model_version", F.lit(model_version))


def append_decisions(guarded: DataFrame, path: str, model_version: str) -> None:
    """Append accepted decisions to the log table; earlier rows are never changed."""
    accepted(guarded, model_version).withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def latest_decisions(log: DataFrame, by: Sequence[str] = ("store_id", "item_id", "order_date")) -> DataFrame:
    """Newest decision (highest id) per item and order date; combined on the map side."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("d")).select(*by, "d.*")


def order_review(orders: DataFrame, log: DataFrame, status: str | None = None) -> DataFrame:
    """Orders with the status and quantity of their latest decision, ``pending`` without one."""
    last = latest_decisions(log).select("store_id", "item_id", "order_date", F.col("action").alias("__a"), F.col("final_qty").alias("final_qty"))
    out = orders.join(last, ["store_id", "item_id", "order_date"], "left")
    out = out.withColumn("status", F.coalesce("__a", F.lit("pending"))).drop("__a")
    return out.where(F.col("status") == status) if status else out


def audit_log(log: DataFrame, limit: int = 200, store: str | None = None) -> DataFrame:
    """Newest decisions first (a top-k report)."""
    rows = log if store is None else log.where(F.col("store_id") == store)
    return rows.orderBy(F.col("id").desc()).limit(limit)


def store_catalogue(series: DataFrame, entity: str = "city") -> DataFrame:
    return series.groupBy("store_id", entity).agg(F.count(F.lit(1)).alias("items"))


def item_catalogue(series: DataFrame, store: str, columns: Sequence[str]) -> DataFrame:
    return series.where(F.col("store_id") == store).select(*columns)


def in_scope(df: DataFrame, entitlements: DataFrame, user: str | Column) -> DataFrame:
    """Rows of the stores a user may see (row-level access by semi-join)."""
    mine = entitlements.where(F.col("user") == user).select("store_id").distinct()
    return df.join(mine, "store_id", "left_semi")


def ranked_drivers(rows: DataFrame, drivers: dict[str, str], by: Sequence[str]) -> DataFrame:
    """(by..., drivers): array of (factor, effect_pct) = 100 * (exp(mean) - 1), strongest first.
    ``drivers`` maps column to label."""
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in drivers])
    effect = {c: F.exp(F.col(c)) - 1 for c in drivers}
    parts = F.filter(F.array(*[F.when(e.isNotNull(), F.struct((-F.abs(e)).alias("o"), F.lit(lab).alias("factor"), F.round(100 * e, 1).alias("effect_pct")))
                               for (c, lab), e in zip(drivers.items(), effect.values())]), lambda p: p.isNotNull())
    return means.select(*by, F.transform(F.array_sort(parts), lambda p: F.struct(p["factor"].alias("factor"), p["effect_pct"].alias("effect_pct"))).alias("drivers"))


def store_forecast(nodes: DataFrame, store: str) -> DataFrame:
    """Store total and its categories with readable labels."""
    total, prefix = f"S:{store}", f"SC:{store}|"
    rows = nodes.where((F.col("node_id") == total) | F.col("node_id").startswith(prefix))
    label = F.when(F.col("node_id") == total, "store total").otherwise(F.replace(F.col("node_id"), F.lit(prefix), F.lit("")))
    return rows.select(label.alias("node"), *[c for c in nodes.columns if c != "node_id"])


def normalised(df: DataFrame, digits: int = 3) -> DataFrame:
    """Output form: non-finite numbers become NULL, floats are rounded, timestamps are ISO dates."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(finite(name), digits).alias(name))
        elif kind.startswith("timestamp") or kind == "date":
            out.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
