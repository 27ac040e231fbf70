"""Sharding by vector bin packing: bytes, tokens and rows are balanced together, groups of equal texts stay whole.

Each group is placed on the shard where the dot product of its (bytes, tokens, rows) with the shard's residual capacity
is highest, largest group first.  Packing itself sees a bounded list: a group over ``1 / (ITEMS * shards)`` of any
total is an item of its own (at most ``3 * ITEMS * shards`` of them); one over half a shard is cut into parts of about
that share, so a text that makes up a third of all rows spreads over shards; all other groups are pooled by hash
into ``ITEMS * shards`` items.  Group weights are summed map-side; no text is shuffled.

Slots are numbered without a window over a shard: rows of a shard are dealt to buckets of about ``BUCKET_ROWS`` by a
hash of the id, numbered there, and moved up by the rows of earlier buckets.

Law: ``bytes`` (sizes near equal; tokens and rows are balanced as far as that allows).  Defined results: a null text has
no bytes and no tokens and groups with the empty text; rows with equal id and text are interchangeable and
each gets a slot; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut

SHARDS = 24
#: Items of the packing for each shard.
ITEMS = 64
#: Every row has a header of so many bytes.
ROW_BYTES = 8
BUCKET_ROWS = 50_000
AXES = ("bytes", "tokens", "rows")
#: Weights of the dot product: bytes are the law, the others follow as far as they can.
IMPORTANCE = (6.0, 1.0, 1.0)


def pack(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``weights``: bytes, tokens, rows), given in a fixed order."""
    total = weights.sum(axis=0)
    share = weights / np.where(total > 0, total / shards, 1.0)  # in units of a shard's capacity
    importance = np.array(IMPORTANCE)
    order = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
    residual, where = np.ones((shards, share.shape[1])), np.zeros(len(share), np.int64)
    for i in order:
        s = int(np.argmax(np.round(residual @ (share[i] * importance), 12)))
        where[i] = s
        residual[s] -= share[i]
    return where


def _described(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w"))  # one character a word, and leading blanks
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.cast("long").alias("tokens"),
                       F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("group"), text).alias("g2"))


def placed(docs: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard of each row."""
    rows = cut(_described(docs))
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    limit = [max(1, (total[a] or 0) // (shards * items)) for a in AXES]
    half = [max(1, (total[a] or 0) / (2 * shards)) for a in AXES]
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    over = reduce(or_, [F.col(a) > cap for a, cap in zip(AXES, limit)])
    fine = F.least(F.greatest(*[F.ceil(F.col(a) / cap) for a, cap in zip(AXES, limit)]), F.col("rows"))
    pieces = F.when(reduce(or_, [F.col(a) > cap for a, cap in zip(AXES, half)]), fine).otherwise(F.lit(1))
    # bounded: the limits leave room for so many large groups only; rows go to a group's parts by a hash of the id
    heavy = F.broadcast(cut(groups.where(over).select("g1", "g2", pieces.alias("parts"))))
    cell = F.pmod(F.xxhash64("g1", "g2"), F.lit(shards * items))
    item = F.when(F.col("parts").isNull(), cell.cast("string")).otherwise(
        F.concat_ws(".", F.lit("g"), F.hex("g1"), F.hex("g2"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("string")))
    known = rows.join(heavy, ["g1", "g2"], "left").withColumn("item", item)
    weights = known.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).toPandas().sort_values("item")
    where = pack(weights[list(AXES)].to_numpy(float), shards)
    table = docs.sparkSession.createDataFrame(list(zip(weights["item"].tolist(), where.tolist())), "item string, shard int")
    return known.join(F.broadcast(table), "item").select("doc_id", "size", "text_crc32", "tokens", "shard")  # bounded: the items


def numbered(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard."""
    rows = cut(rows)
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets)))
    before = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(before.select("shard", "bucket", "base"), ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("inside"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    out = numbered(placed(docs, shards), shards)
    nothing: Column = F.lit(None).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), nothing.alias("grown_shard"), "tokens")
