"""Data contracts: declared columns, ordered rules, quarantine, reports.

A contract is an ordered list of ``(reason, predicate)`` rules.  ``annotate`` adds
one ``reason`` column holding the first rule a row breaks; clean and quarantined
rows are then two filters over the same plan.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.functions.numeric import is_true

Rule = tuple[str, Column]

# Feed columns, allowed codes, limits and key patterns of the retail feeds.
CATEGORIES = ["beverages", "snacks", "personal_care", "monsoon_seasonal"]
EVENT_KINDS = ["festival", "public_holiday"]
STORE_PATTERN = r"^S\d{2}$"
ITEM_PATTERN = r"^I\d{3}$"
ACTIONS = ["approve", "override", "reject"]
TEMP_RANGE = (-5.0, 50.0)
RAIN_RANGE = (0.0, 1000.0)
HUMIDITY_RANGE = (0.0, 100.0)
DISCOUNT_RANGE = (0.0, 0.9)


@dataclass
class Contract:
    """Declared columns plus row rules and key columns that must be unique."""

    columns: dict[str, str]
    rules: list[Rule] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    strict: bool = True

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.columns.items()))


def missing(c: str) -> Column:
    return F.col(c).isNull()


def outside(c: str, lo: float, hi: float) -> Column:
    return ~F.col(c).between(lo, hi)


def unmatched(c: str, pattern: str) -> Column:
    return ~F.col(c).rlike(pattern)


def not_among(c: str, allowed: Sequence[str]) -> Column:
    return ~F.col(c).isin(list(allowed))


def first_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first broken rule, NULL when the row keeps all of them."""
    return F.coalesce(*[F.when(is_true(pred), F.lit(name)) for name, pred in rules],
                      F.lit(None).cast("string"))


def all_reasons(rules: Sequence[Rule]) -> Column:
    """Every broken rule at once (array of names)."""
    return F.filter(F.array(*[F.when(is_true(p), F.lit(n)) for n, p in rules]), lambda r: r.isNotNull())


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast to the declared types; a value that cannot be cast is listed in ``bad_cast``.

    Columns outside the contract raise for a strict contract, as do missing ones.
    """
    unknown = [c for c in df.columns if c not in contract.columns and not c.startswith("_")]
    absent = [c for c in contract.columns if c not in df.columns]
    if absent or (contract.strict and unknown):
        raise ValueError(f"columns missing {absent}, not declared {unknown if contract.strict else []}")
    cast = {c: F.col(c).try_cast(t) for c, t in contract.columns.items()}
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & cast[c].isNull(), F.lit(c)) for c in cast]),
                   lambda n: n.isNotNull())
    extra = [F.col(c) for c in df.columns if c not in contract.columns]
    return df.select(*[v.alias(c) for c, v in cast.items()], *extra, bad.alias("bad_cast"))


# ----------------------------------------------------------------- key checks
def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def flag_repeats(df: DataFrame, keys: list[str], order: list[str], out: str = "is_repeat") -> DataFrame:
    """True on every row but the first of its key, "first" by the ``order`` columns.

    Keys are counted by hash; only rows of keys with more than one row are looked at for
    the first (a struct minimum sorts its input), and one row for each such key is joined
    back, so a hot key is never gathered in one task: the probe side is split by AQE, the
    build side holds a single row for it.  ``df`` is read three times; ``order`` must tell
    the rows of one key apart (``sources.feeds.with_ingest_order`` for feed order).
    """
    ident = F.struct(*[F.col(c) for c in order])
    names = [f"__k{i}" for i in range(len(keys))]

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)])

    repeated = repeated_keys(df, keys).select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    rows = df.select(*keys, ident.alias("__ident"))
    firsts = (rows.join(repeated, same(rows, repeated), "left_semi").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
              .agg(F.min("__ident").alias("__first")))
    joined = df.join(firsts, same(df, firsts), "left")
    return joined.select(*[df[c] for c in df.columns],
                         (F.col("__first").isNotNull() & (F.col("__first") != ident)).alias(out))


# ------------------------------------------------------------------ the feeds
def sales_contract(max_date) -> Contract:
    units, opening, received, closing = (F.col(c) for c in
                                         ("units_sold", "on_hand_open", "receipts", "on_hand_close"))
    return Contract(
        columns={"date": "date", "store_id": "string", "item_id": "string", "units_sold": "bigint",
                 "unit_price": "double", "on_hand_open": "bigint", "receipts": "bigint",
                 "on_hand_close": "bigint"},
        rules=[("date_in_future", F.col("date") > F.lit(max_date).cast("date")),
               ("negative_units", units < 0),
               ("bad_price", missing("unit_price") | F.isnan("unit_price") | (F.col("unit_price") <= 0)),
               ("negative_stock", (opening < 0) | (received < 0) | (closing < 0)),
               ("stock_balance", (units >= 0) & (opening + received - units != closing))],
        unique=["date", "store_id", "item_id"],
        not_null=["date", "store_id", "item_id", "units_sold", "on_hand_open", "receipts", "on_hand_close"])


def sales_schema_rules(store_pattern: str = STORE_PATTERN, item_pattern: str = ITEM_PATTERN) -> list[Rule]:
    """Final gate after the named rules: anything still wrong is reason ``schema``."""
    nulls = reduce(lambda a, b: a | b, [missing(c) for c in sales_contract("2000-01-01").not_null])
    return [("schema", nulls | unmatched("store_id", store_pattern) | unmatched("item_id", item_pattern))]


def items_contract() -> Contract:
    return Contract(
        columns={"item_id": "string", "category": "string", "price": "double", "pack_size": "int",
                 "launch_date": "date"},
        rules=[("category", not_among("category", CATEGORIES)), ("price", F.col("price") <= 0),
               ("pack_size", F.col("pack_size") <= 0)],
        unique=["item_id"], not_null=["item_id", "category", "price", "pack_size", "launch_date"])


def stores_contract() -> Contract:
    return Contract(columns={"store_id": "string", "city": "string", "region": "string"},
                      unique=["store_id"], not_null=["store_id", "city", "region"])


def weather_contract() -> Contract:
    return Contract(
        columns={"date": "date", "city": "string", "temp_max": "double", "rain_mm": "double", "humidity": "double"},
        rules=[("temp_max", outside("temp_max", *TEMP_RANGE)), ("rain_mm", outside("rain_mm", *RAIN_RANGE)),
               ("humidity", outside("humidity", *HUMIDITY_RANGE))],
        unique=["date", "city"], not_null=["date", "city"], strict=False)


def search_contract() -> Contract:
    return Contract(
        columns={"date": "date", "category": "string", "search_index": "double"},
        rules=[("category", not_among("category", CATEGORIES)), ("search_index", F.col("search_index") < 0)],
        unique=["date", "category"], not_null=["date", "category"])


def promotions_contract() -> Contract:
    return Contract(
        columns={"item_id": "string", "region": "string", "date_start": "date", "date_end": "date",
                 "discount": "double"},
        rules=[("discount", outside("discount", *DISCOUNT_RANGE)),
               ("promo_dates", F.col("date_end") < F.col("date_start"))],
        not_null=["item_id", "region", "date_start", "date_end", "discount"])


def events_contract() -> Contract:
    return Contract(
        columns={"date": "date", "event": "string", "kind": "string", "source": "string", "span_days": "int",
                 "buildup_days": "int"},
        rules=[("kind", not_among("kind", EVENT_KINDS)), ("span_days", F.col("span_days") < 1),
               ("buildup_days", F.col("buildup_days") < 0)],
        not_null=["date", "event", "kind", "source", "span_days", "buildup_days"])


# ------------------------------------------------------------------ operators
def annotate(df: DataFrame, rules: Sequence[Rule], *, keys: list[str] | None = None,
             order: list[str] | None = None, gate: Sequence[Rule] = ()) -> DataFrame:
    """Add ``reason``: duplicate_key first (when keys are given), then ``rules`` in
    order, then the final ``gate``."""
    rules = [*rules, *gate]
    if keys:
        df = flag_repeats(df, keys, order or keys, "__repeat")
        rules = [("duplicate_key", F.col("__repeat")), *rules]
    return df.withColumn("reason", first_reason(rules)).drop("__repeat")


def clean_rows(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("reason").isNull()).drop("reason")


def quarantined_rows(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("reason").isNotNull())


def flag_unknown_keys(df: DataFrame, dims: Sequence[tuple[DataFrame, str]], reason: str = "unknown_key") -> DataFrame:
    """Referential check: rows whose key is in no dimension row get ``reason``.

    Each dimension is reduced to its distinct keys and left-joined; the optimizer
    broadcasts it when its measured size allows and shuffles it otherwise.
    """
    if "reason" not in df.columns:
        df = df.withColumn("reason", F.lit(None).cast("string"))
    for i, (dim, key) in enumerate(dims):
        seen = dim.select(key).distinct().withColumn(f"__seen{i}", F.lit(True))
        df = df.join(seen, key, "left")
    unknown = reduce(lambda a, b: a | b, [F.col(f"__seen{i}").isNull() for i in range(len(dims))])
    return (df.withColumn("reason", F.coalesce("reason", F.when(unknown, F.lit(reason))))
              .drop(*[f"__seen{i}" for i in range(len(dims))]))


def with_stockout(df: DataFrame) -> DataFrame:
    """Shelf empty at close: sales of that day under-count demand."""
    return df.withColumn("stockout", F.col("on_hand_close") == 0)


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows of a dimension feed that break its contract, with every broken rule."""
    rules = [(f"{c}_missing", missing(c)) for c in contract.not_null] + contract.rules
    out = df.withColumn("reasons", all_reasons(rules) if rules else F.array().cast("array<string>"))
    if contract.unique:
        dup = (repeated_keys(df, contract.unique).drop("rows")
               .withColumn("__dup", F.array(F.lit("not_unique"))))
        out = (out.join(dup, contract.unique, "left")
                  .withColumn("reasons", F.concat("reasons", F.coalesce("__dup", F.array().cast("array<string>"))))
                  .drop("__dup"))
    return out.where(F.size("reasons") > 0)


def require_valid(df: DataFrame, contract: Contract, name: str) -> DataFrame:
    """Fail fast on a broken dimension feed; returns the coerced feed."""
    typed = coerce(df, contract)
    if not typed.where(F.size("bad_cast") > 0).isEmpty():
        raise ValueError(f"{name}: values that do not fit the declared types")
    typed = typed.drop("bad_cast")
    bad = violations(typed, contract)
    if not bad.isEmpty():
        raise ValueError(f"{name}: rows break the contract")
    return typed


def quality_report(annotated: DataFrame) -> DataFrame:
    """Long (metric, key, value) report of an annotated sales feed in one pass over it."""
    clean = F.col("reason").isNull()
    by_reason = annotated.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("on_hand_close") == 0).cast("int")).alias("so"),
        F.min("date").alias("lo"), F.max("date").alias("hi"))
    total = by_reason.agg(
        F.sum("n").alias("raw"), F.sum(F.when(clean, F.col("n")).otherwise(0)).alias("ok"),
        F.sum(F.when(clean, F.col("so"))).alias("so"),
        F.min(F.when(clean, F.col("lo"))).alias("lo"), F.max(F.when(clean, F.col("hi"))).alias("hi"))
    values = {"rows_raw": F.col("raw"), "rows_clean": F.col("ok"), "rows_quarantined": F.col("raw") - F.col("ok"),
              "stockout_days": F.col("so"), "first_date": F.col("lo"), "last_date": F.col("hi")}
    total = total.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in values.items()])).alias("r"))
    reasons = by_reason.where(~clean).select(F.lit("quarantine_reason").alias("metric"),
                                             F.col("reason").alias("key"), F.col("n").cast("string").alias("value"))
    return total.select("r.metric", F.lit("").alias("key"), "r.value").unionByName(reasons)


#: Every reason that the sales checks can give.
SALES_REASONS = ["duplicate_key", "date_in_future", "negative_units", "bad_price", "negative_stock", "stock_balance", "schema", "unknown_key"]


def observed_report(annotated: DataFrame, write: Callable[[DataFrame], None], reasons: Sequence[str] = tuple(SALES_REASONS)) -> DataFrame:
    """``quality_report`` of an annotated feed, gathered while ``write`` writes it: no further pass over the rows.

    A reason that is not among ``reasons`` raises, so that none is left out of the report.
    """
    clean, seen = F.col("reason").isNull(), Observation()
    counts = {r: F.count_if(F.col("reason") == r) for r in reasons}
    write(annotated.observe(seen, F.count(F.lit(1)).alias("raw"), F.count_if(clean).alias("ok"), F.count_if(clean & (F.col("on_hand_close") == 0)).alias("so"),
                            F.min(F.when(clean, F.col("date"))).alias("lo"), F.max(F.when(clean, F.col("date"))).alias("hi"), *[c.alias(f"r_{r}") for r, c in counts.items()]))
    got = seen.get
    if got["raw"] - got["ok"] != sum(got[f"r_{r}"] for r in reasons):
        raise ValueError(f"rows with a reason that is not one of {list(reasons)}")
    values = {"rows_raw": got["raw"], "rows_clean": got["ok"], "rows_quarantined": got["raw"] - got["ok"], "stockout_days": got["so"] if got["ok"] else None,
              "first_date": got["lo"], "last_date": got["hi"]}
    rows = [(k, "", None if v is None else str(v)) for k, v in values.items()] + [("quarantine_reason", r, str(got[f"r_{r}"])) for r in reasons if got[f"r_{r}"]]
    return annotated.sparkSession.createDataFrame(rows, "metric string, key string, value string")


def missing_weather_rows(weather: DataFrame) -> DataFrame:
    return weather.agg(F.count_if(F.col("temp_max").isNull() | F.col("rain_mm").isNull()).alias("rows_missing"))
