"""SimHash near-duplicates: 64-bit fingerprints, linked at 2 or fewer differing bits, found with vantage-point trees.

A tree built from a sample of the fingerprints deals all of them to shards.  At a node with vantage point v and
radius m, fingerprints with d(f, v) <= m go inside and those with d(f, v) > m - 2 go outside; by the triangle
inequality two fingerprints that differ in 2 bits or fewer always meet in one child, the ones in the overlap being
copied to both.  Within a shard the same split goes on, down to blocks that are compared bit by bit.  Where
fingerprints lie too close for any vantage point to part them, pairs are found exactly by shared midpoints: f and g
differ in 2 bits or fewer if and only if some key within one bit of f is also within one bit of g, and at most 65
fingerprints share a key.  A shard reports a spanning forest, never all pairs; forests are joined across shards by
alternating star contraction.

Only distinct fingerprints are dealt, so exact copies cost nothing.  The sample (``SAMPLE_MOST`` fingerprints at
most, in expectation) only shapes the tree; every fingerprint is indexed.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows
get the same component; a null ``doc_id`` never names a component that has another id; extra columns are ignored
by ``components`` and kept by ``kept_documents``.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.functions.lineage import cut
from demandsense.llm.shipping import by_value

by_value(__name__)

SHINGLE, SEED, RADIUS = 3, 42, 2
SHARD = 4_096
SAMPLE_A_SHARD, SAMPLE_LEAST, SAMPLE_MOST = 32, 4_096, 1 << 20
BLOCK, VANTAGES = 384, 6
#: A split must leave at most these shares of the points: in the larger child, and in both with their overlap.
LARGER_MOST, BOTH_MOST = 0.85, 1.4
VOTE_ROWS = 1 << 15


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII blanks part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), VOTE_ROWS):
        part = h[k: k + VOTE_ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    values = np.array([fingerprint(t.as_py() or b"") for t in text.cast(pa.binary())], np.uint64)  # one text at a time
    return pa.array(values.view(np.int64))


class Node(NamedTuple):
    vantage: int
    radius: int
    inside: int   # index of a node, or -1 - shard
    outside: int


class Tree(NamedTuple):
    nodes: tuple[Node, ...]
    shards: int
    close: tuple[int, ...]  # shards that no vantage point could part


def best_split(f: np.ndarray, tries: int) -> tuple[int, int] | None:
    """(vantage, radius) with the least sum of squared child sizes; None if it would not part the points well enough."""
    best, n = None, len(f)
    for k in range(tries):
        v = f[(k * 2654435761 + n // 3) % n]
        seen = np.cumsum(np.bincount(np.bitwise_count(f ^ v), minlength=65))
        m = np.arange(65)
        inside, outside = seen.astype(float), n - np.where(m >= RADIUS, seen[np.maximum(m - RADIUS, 0)], 0)
        cost = inside ** 2 + outside ** 2
        r = int(np.argmin(cost))
        if best is None or cost[r] < best[3]:
            good = max(inside[r], outside[r]) <= LARGER_MOST * n and inside[r] + outside[r] <= BOTH_MOST * n
            best = (int(v), r, bool(good), float(cost[r]))
    return best[:2] if best and best[2] else None


def parts(f: np.ndarray, vantage: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(f ^ np.uint64(vantage))
    return d <= radius, d > radius - RADIUS


def build_tree(sample: np.ndarray, most: int) -> Tree:
    """Split until a shard has at most ``most`` sampled fingerprints."""
    nodes: list[Node | None] = []
    close: list[int] = []
    shards = 0

    def grow(f: np.ndarray) -> int:
        nonlocal shards
        split = best_split(f, VANTAGES) if len(f) > most else None
        if split is None:
            if len(f) > most:
                close.append(shards)
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inside, outside = parts(f, *split)
        nodes[at] = Node(split[0], split[1], grow(f[inside]), grow(f[outside]))
        return at

    grow(sample)
    return Tree(tuple(nodes), shards, tuple(close))


def route(tree: Tree, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each copy."""
    rows, shards, todo = [], [], [(0 if tree.nodes else -1, np.arange(len(f)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            rows.append(idx)
            shards.append(np.full(len(idx), -at - 1))
            continue
        node = tree.nodes[at]
        inside, outside = parts(f[idx], node.vantage, node.radius)
        todo += [(node.inside, idx[inside]), (node.outside, idx[outside])]
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def midpoint_links(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links by shared keys within one bit; ``f`` distinct."""
    index = np.arange(len(f))
    a, b = [], []
    slices = max(1, len(f) >> 18)
    bits = max(slices - 1, 0).bit_length()
    for s in range(1 << bits):
        keys, owner = [], []
        for flip in [0] + [1 << k for k in range(64)]:
            k = f ^ np.uint64(flip)
            on = (k >> np.uint64(64 - bits)) == s if bits else slice(None)
            keys.append(k[on])
            owner.append(index[on])
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        same = key[1:] == key[:-1]
        a.append(own[:-1][same])
        b.append(own[1:][same])
    return np.concatenate(a), np.concatenate(b)


def shard_links(f: np.ndarray) -> np.ndarray:
    """Root index of each of the distinct fingerprints, linked at RADIUS or fewer bits."""
    a, b, todo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.arange(len(f))]
    while todo:
        idx = todo.pop()
        x = f[idx]
        if len(idx) <= BLOCK:
            i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS, 1))
            a.append(idx[i])
            b.append(idx[j])
            continue
        split = best_split(x, VANTAGES)
        if split is None:
            i, j = midpoint_links(x)
            a.append(idx[i])
            b.append(idx[j])
            continue
        inside, outside = parts(x, *split)
        todo += [idx[inside], idx[outside]]
    return roots(len(f), np.concatenate(a), np.concatenate(b))


LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
DEALT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("fp", T.LongType())])


def _dealer(tree: Tree):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            row, shard = route(tree, f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(f[row])], names=["shard", "fp"])
    return deal


def _forest(table: pa.Table) -> pa.Table:
    f = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
    root = shard_links(f)
    on = root != np.arange(len(f))
    signed = f.view(np.int64)
    return pa.table([pa.array(signed[on]), pa.array(signed[root[on]])], names=["u", "v"])


def _midpoints(fp: DataFrame) -> DataFrame:
    """Links of the fingerprints of shards that could not be parted; at most 65 fingerprints meet at a key."""
    keys = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    near = fp.select("fp", F.explode(keys).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    met = near.groupBy("key").agg(F.collect_set("fp").alias("f")).where(F.size("f") > 1)
    return met.select(F.explode("f").alias("u"), F.array_min("f").alias("v")).where("u <> v").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links that join each component of the distinct ``fp`` values of ``fps``."""
    n = fps.count()
    want = min(max(SAMPLE_LEAST, SAMPLE_A_SHARD * -(-n // SHARD)), SAMPLE_MOST)
    sampled = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < want).select("fp").toPandas()["fp"].to_numpy(np.int64)
    tree = build_tree(np.sort(sampled).view(np.uint64), max(1, int(SHARD * len(sampled) / max(n, 1))))
    dealt = fps.select("fp").mapInArrow(_dealer(tree), DEALT)
    if not tree.close:
        return dealt.groupBy("shard").applyInArrow(_forest, LINK)
    dealt = cut(dealt)
    close = F.col("shard").isin(list(tree.close))
    return dealt.where(~close).groupBy("shard").applyInArrow(_forest, LINK).union(_midpoints(dealt.where(close).select("fp").distinct()))


def contract(edges: DataFrame) -> DataFrame:
    """(u, v): each node of ``edges`` that is not the least of its component, and that least node."""
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hooked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    edges = cut(edges.select("u", "v").where("u <> v"))
    seen = mark(edges)
    while seen[0]:
        edges = cut(small(cut(large(edges))))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def _assigned(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), fp, root (a fingerprint), component_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = cut(docs.select("doc_id", F.xxhash64(text).alias("content"), F.arrow_udf(_fingerprints, T.LongType())(F.col("text")).alias("fp")))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    star = contract(links(fps)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = fps.join(star, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(named, "root"), "fp")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs``."""
    return _assigned(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the least doc_id stays."""
    return heads(docs, _assigned(docs))


def heads(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """The row of the least doc_id of each component; ``assigned`` has doc_id, content, root, component_id of each row."""
    head = assigned.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "content").agg(F.count("*").alias("n"))
    head = cut(head.groupBy("root", "doc_id").agg(F.min("content").alias("content"), F.min_by("n", "content").alias("n")))
    head = head.select(F.col("doc_id").alias("head_id"), F.col("content").alias("head_content"), F.col("n").alias("head_n")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_content"))
    stay = packed.join(head, F.col("row_id").eqNullSafe(F.col("head_id")) & (F.col("row_content") == F.col("head_content")))
    if not head.where("head_n > 1").isEmpty():  # the same row twice: one of them
        stay = stay.groupBy("row_id", "row_content").agg(F.first("row").alias("row"))
    return stay.select("row.*")
