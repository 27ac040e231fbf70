"""Ranked lexical search by the Best Position Algorithm.

Documents become index rows: how many terms they have and how often each term of the items occurs in them.  Index rows
are dealt to shards of about ``SHARD`` documents.  A shard keeps an impact list for each term (documents by falling
impact) and the place of every document in every list.  For an item its lists are read from the top in step; each
document met is looked up directly in all of them, which gives its whole score and marks its places as seen.  A list's best position
is the end of its first unbroken run of seen places; no unseen document can have more than the sum of the impacts right
after the best positions, so a list stops counting as soon as direct accesses have filled it up.  Reading stops when that
sum is strictly below the k-th score (equal scores are decided by id), and a task hands the k-th score on to its next shard.
Scores are whole 64-bit numbers.

Items are handled in blocks of about ``BLOCK_BYTES`` of text, one pass over the documents for each; a block's
terms are broadcast.  Within a shard, items are taken in groups of about ``GROUP`` terms, which bounds the table of places.
Results leave a task as k rows for each item and are ranked in two steps, so no task gets the rows of all shards.

Defined results: a null text has no terms; an item without terms, or whose terms no document holds, has no rows; equal
rows of ``items`` are one item, rows with one id and different texts are ranked each on its own; repeated documents are
ranked each on its own; a null ``doc_id`` comes last among equal scores; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from demandsense.functions.lineage import cut
from demandsense.llm.shipping import by_value

by_value(__name__)

MOST = 50
BLOCK_BYTES = 1 << 20
#: At most 2 ** 15 - 1, so that places fit in two bytes.
SHARD = 1 << 13
GROUP = 1 << 12
FIRST_STEP = 32
RANK_PARTS = 64

# Weight and impact are whole numbers in thousandths and billionths.
WEIGHT_UNIT, IMPACT_UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 20, 50

#: Bytes of terms, A-Z lowered; all others become blanks.
CHARS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(CHARS).split()


def _indexing(numbers, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = numbers.value.get
        for batch in batches:
            n, ends, found, often = [], [0], [], []
            for t in batch.column(1).cast(pa.binary()):  # one text at a time
                words = terms(t.as_py() or b"")
                known = np.array([x for x in map(number_of, words) if x is not None], np.int32)
                which, times = np.unique(known, return_counts=True)
                n.append(len(words))
                found.append(which)
                often.append(times.astype(np.int32))
                ends.append(ends[-1] + len(which))
            offsets = pa.array(ends, pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in flat]], schema=schema)
    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_UNIT * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    length = (100 - LENGTH_SHARE) + (LENGTH_SHARE * n * docs) // total
    return weight * ((IMPACT_UNIT * tf) // (TF_UNIT * tf + LENGTH_UNIT * length))


class Shard:
    """Impact lists over some documents: ``doc`` and ``impact`` by term and falling impact, list ``t`` from ``start[t]`` to ``start[t + 1]``."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def places(self, group: np.ndarray) -> np.ndarray:
        """Where each document stands in each list of the group, -1 if it is not in it."""
        out = np.full((len(group), self.n_docs), -1, np.int16)
        for k, t in enumerate(group.tolist()):
            a, b = self.start[t], self.start[t + 1]
            out[k, self.doc[a:b]] = np.arange(b - a)
        return out


class Top:
    """The k best (score, id, whether the id is null) so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.void = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def kth(self) -> int:
        """No score below this can enter; 0 while there are fewer than k."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, void: np.ndarray) -> None:
        on = (score > 0) & (score >= self.kth)
        score, ids, void = (np.concatenate([a, b[on]]) for a, b in ((self.score, score), (self.id, ids), (self.void, void)))
        order = np.lexsort((ids, void, -score))[: self.k]
        self.score, self.id, self.void = score[order], ids[order], void[order]


def search(shard: Shard, lists: np.ndarray, place: np.ndarray, ids: np.ndarray, void: np.ndarray, top: Top) -> int:
    """Add the shard's best documents for an item (terms ``lists``, their rows of ``place``) to ``top``; returns how many documents were looked up."""
    begin = shard.start[lists]
    size = shard.start[lists + 1] - begin
    on = size > 0
    begin, size, place = begin[on], size[on], place[on]
    if not len(begin):
        return 0
    base = np.cumsum(size) - size
    seen = np.zeros(int(size.sum()), bool)
    best = np.zeros(len(size), np.int64)
    met = np.zeros(shard.n_docs, bool)
    depth, step = 0, FIRST_STEP
    while True:
        read = np.concatenate([shard.doc[b + depth: b + min(depth + step, s)] for b, s in zip(begin.tolist(), size.tolist()) if s > depth] or [np.empty(0, np.int64)])
        new = np.unique(read[~met[read]])
        met[new] = True
        at = place[:, new].astype(np.int64)
        hit = at >= 0
        top.add(np.where(hit, shard.impact[begin[:, None] + np.maximum(at, 0)], 0).sum(axis=0), ids[new], void[new])
        seen[(base[:, None] + at)[hit]] = True
        unseen = 0
        for k, (b, s) in enumerate(zip(base.tolist(), size.tolist())):
            if best[k] < s:
                rest = seen[b + best[k]: b + s]
                gap = int(rest.argmin())
                best[k] = s if rest[gap] else best[k] + gap
                unseen += int(shard.impact[begin[k] + best[k]]) if best[k] < s else 0
        if unseen == 0 or unseen < top.kth:
            return int(np.count_nonzero(met))
        depth, step = depth + step, 2 * step


def groups_of(items: Sequence[np.ndarray]) -> list[list[int]]:
    """Items in groups of about ``GROUP`` terms."""
    out: list[list[int]] = [[]]
    held = 0
    for k, lists in enumerate(items):
        if out[-1] and held + len(lists) > GROUP:
            out.append([])
            held = 0
        out[-1].append(k)
        held += len(lists)
    return out


def _ranking(shared, schema: pa.Schema, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, docs, total = shared.value
        groups, tops = groups_of(items), [Top(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def one_shard() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            owned = [table.column(c).combine_chunks() for c in range(table.num_columns)]
            found, often = (a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in owned[2:])
            doc = np.repeat(np.arange(table.num_rows), np.diff(found.offsets.to_numpy()))
            term, tf, n = found.flatten().to_numpy(), often.flatten().to_numpy().astype(np.int64), table.column(1).to_numpy()
            shard = Shard(term, doc, impacts(weight[term], tf, n[doc], docs, total), len(weight), table.num_rows)
            void = table.column(0).is_null().to_numpy()
            ids = table.column(0).fill_null(0).to_numpy()
            for group in filter(None, groups):
                lists = np.unique(np.concatenate([items[i] for i in group]))
                place = shard.places(lists)
                for i in group:
                    search(shard, items[i], place[np.searchsorted(lists, items[i])], ids, void, tops[i])

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                if sum(b.num_rows for b in held) + part.num_rows > SHARD:
                    one_shard()
                held.append(part)
        if held:
            one_shard()
        for i, top in enumerate(tops):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.score), i), pa.int32()), pa.array(top.id, pa.int64(), mask=top.void), pa.array(top.score, pa.int64())], schema=schema)
    return run


def _first(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for the items of a block, by their place in ``items``."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    lists = [np.array(sorted({number.setdefault(t, len(number)) for t in terms((i.text or "").encode())}), np.int64) for i in items]
    kind = T.StructType([T.StructField("doc_id", T.LongType())] + T._parse_datatype_string("n long, terms array<int>, tfs array<int>").fields)
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    index = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_indexing(spark.sparkContext.broadcast(number), arrow), kind))
    said = index.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("total"), F.sum((F.size("terms") > 0).cast("long")).alias("held")).first()
    # one row for each term of the block
    held_by = {r.term: r.df for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    df = np.array([held_by.get(t, 0) for t in range(len(number))], np.int64)
    shared = spark.sparkContext.broadcast((lists, weights(df, said.docs or 0), said.docs or 0, said.total or 0))
    out = T._parse_datatype_string("item int, doc_id long, score long")
    rows = index.where(F.size("terms") > 0).repartition(max(1, math.ceil((said.held or 0) / SHARD)))
    return rows.mapInArrow(_ranking(shared, to_arrow_schema(out), k), out)


def ranked(docs: DataFrame, items: DataFrame, k: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    asked = cut(items.select("item_id", "text").distinct())
    size = asked.agg(F.sum(F.octet_length("text") + 1).alias("size")).first()["size"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    of_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    done = []
    for b in range(blocks):
        block = asked.where(of_block == b).collect()  # about block_bytes of text
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
        part = _block(docs, block, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(RANK_PARTS)))
        top = _first(_first(part, ["item", "part"], k).select("item", "doc_id", "score"), ["item"], k)
        top = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: the block's items
        done.append(top if blocks == 1 else cut(top))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
