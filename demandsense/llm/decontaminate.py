"""Benchmark decontamination by spaced-seed hashing, tolerant of substituted words.

A document and a benchmark item overlap where ``WINDOW`` aligned words differ in at most ``SUBSTITUTED`` places
(11 equal of 13: a similarity over 0.8).  Fixed masks hash some positions of a window and ignore the others;
the two masks are chosen so that, wherever two substitutions fall in a window, one of them has an alignment in the
window that misses both.  Equal hashes only propose a diagonal; every proposed diagonal is compared word by word, so
the result is exactly the overlaps of the definition.  An item shorter than the window is its own window, with
one substitution for each five words and masks that are its thirds or halves.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words (in expectation).  Each block is a pass of its own over the
documents, written before the next one begins, so the driver, a broadcast and a worker hold the seeds of one block
at a time, however large the benchmark is.  Documents are never shuffled.  Of an item that a document holds more than once, the
place with most equal words is returned, the first of equals.

Defined results: words are runs of word characters, lower-cased; a null or empty text overlaps nothing; an item
without words matches nothing; a repeated item or document gives a row each; extra columns are ignored or kept;
an empty benchmark leaves all documents clean.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.functions.lineage import cut
from demandsense.llm.shipping import by_value

by_value(__name__)

WINDOW, SUBSTITUTED, WORDS_A_SUBSTITUTION = 13, 2, 5
# For each two positions of the window one of these masks, shifted within it, covers neither.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 9, 10))
BLOCK_WORDS = 500_000
SIEVE_BITS = 22
WORD = re.compile(r"\w+")

OVERLAP = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
                        T.StructField("n_equal", T.IntegerType()), T.StructField("n_words", T.IntegerType())])


class Codes(dict):
    """Word to 64-bit hash; forgets when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 3)
        return code


def words_of(text: str, codes: Codes) -> np.ndarray:
    return np.array([codes[w] for w in WORD.findall(text.lower())], np.uint64)


def tolerated(n: int) -> tuple[int, int]:
    """(window, substitutions) for an item of ``n`` words."""
    return (WINDOW, SUBSTITUTED) if n >= WINDOW else (n, min(SUBSTITUTED, n // WORDS_A_SUBSTITUTION))


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    if n >= WINDOW:
        return MASKS
    _, k = tolerated(n)
    edge = [n * i // (k + 1) for i in range(k + 2)]
    return tuple(tuple(range(a, b)) for a, b in zip(edge, edge[1:]))


def seed_hash(w: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash at each place where the mask fits; position 0 of the result is position ``mask[0]`` of the words."""
    n = len(w) - (mask[-1] - mask[0])
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for at in mask:
        h = (h ^ w[at - mask[0]: at - mask[0] + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Seeds(NamedTuple):
    items: list[tuple[int, np.ndarray]]            # item_id, words
    by_mask: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]  # mask, sorted hashes, item index, position
    sieve: np.ndarray


def seeds_of(items: list[tuple[int, str]]) -> Seeds:
    codes, known = Codes(), []
    made: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for item_id, text in items:
        w = words_of(text or "", codes)
        if not len(w):
            continue
        for mask in masks_for(len(w)):
            if len(w) >= WINDOW:
                shape, h, pos = mask, seed_hash(w, mask), None
            else:  # at its own place in the item only
                shape = tuple(x - mask[0] for x in mask)
                h, pos = seed_hash(w[mask[0]: mask[-1] + 1], shape), np.array([mask[0]])
            pos = np.arange(len(h)) if pos is None else pos
            made.setdefault(shape, []).append((h, np.full(len(h), len(known), np.int32), pos.astype(np.int32)))
        known.append((item_id, w))
    sieve, by_mask = np.zeros(1 << SIEVE_BITS, bool), []
    for shape, got in sorted(made.items()):
        h, item, pos = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(h, kind="stable")
        by_mask.append((shape, h[order], item[order], pos[order]))
        sieve[h >> np.uint64(64 - SIEVE_BITS)] = True
    return Seeds(known, by_mask, sieve)


def proposals(w: np.ndarray, seeds: Seeds) -> set[tuple[int, int]]:
    """(item index, document position of the item's word 0) of each seed hit."""
    out: set[tuple[int, int]] = set()
    for mask, hashes, item, pos in seeds.by_mask:
        h = seed_hash(w, mask)
        at = np.flatnonzero(seeds.sieve[h >> np.uint64(64 - SIEVE_BITS)])
        if not len(at):
            continue
        low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        n = high - low
        if not n.any():
            continue
        doc = np.repeat(at, n)
        seed = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out.update(zip(item[seed].tolist(), (doc - pos[seed]).tolist()))
    return out


def overlap_at(w: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int] | None:
    """(first word, end word, equal words) of the windows that hold on this diagonal, or None."""
    a, b = max(0, start), min(len(w), start + len(item))
    size, allowed = tolerated(len(item))
    if b - a < size:
        return None
    same = w[a:b] == item[a - start: b - start]
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[size:] - run[:-size] >= size - allowed)
    if not len(good):
        return None
    first, end = int(good[0]), int(good[-1]) + size
    return a + first, a + end, int(run[end] - run[first])


def overlaps(text: str, seeds: Seeds, codes: Codes) -> list[tuple[int, int, int, int, int]]:
    """One (item_id, start_word, end_word, n_equal, n_words) for each item: the diagonal with most equal words, the first if tied."""
    w = words_of(text, codes)
    best: dict[int, tuple[int, int, int]] = {}
    for k, start in sorted(proposals(w, seeds)):
        got = overlap_at(w, seeds.items[k][1], start)
        if got and (k not in best or got[2] > best[k][2]):
            best[k] = got
    return [(seeds.items[k][0], *best[k], len(seeds.items[k][1])) for k in sorted(best)]


def _finder(seeds):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes, known = Codes(), Seeds(*seeds.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_equal", pa.int32()), ("n_words", pa.int32())]))
        for batch in texts:
            found = [overlaps(t.as_py() or "", known, codes) for t in batch]  # one text at a time
            yield pa.array([[dict(zip(("item_id", "start_word", "end_word", "n_equal", "n_words"), x)) for x in row] for row in found], kind)
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[int, Callable[[int], Callable[[Column], Column]]]:
    """(number of blocks, finder of a block): ``finder(b)(text)`` is the column of overlaps with the items of block ``b``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * block_words)))  # a word and its blank take two characters at least

    def finder(b: int) -> Callable[[Column], Column]:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        seeds = benchmark.sparkSession.sparkContext.broadcast(tuple(seeds_of(rows)))  # plain values: executors have no copy of the class
        return F.arrow_udf(_finder(seeds), T.ArrayType(OVERLAP))
    return blocks, finder


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, end_word, n_equal, n_words: a row for each document and item that overlap."""
    blocks, finder = blocks_of(benchmark, block_words)
    parts = []
    for b in range(blocks):
        found = docs.select("doc_id", finder(b)(F.col("text")).alias("found"))
        # a plain explode would make Spark test the array's size first, by finding the overlaps a second time
        found = found.select("doc_id", F.explode_outer("found").alias("f")).where("f is not null").select("doc_id", "f.*")
        parts.append(found if blocks == 1 else cut(found))
    return reduce(DataFrame.unionByName, parts)


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their own columns."""
    blocks, finder = blocks_of(benchmark, block_words)
    for b in range(blocks):
        packed = docs.select("text", F.struct("*").alias("row"))
        kept = packed.withColumn("found", finder(b)(F.col("text"))).where(F.size("found") == 0).select("row.*")
        docs = kept if blocks == 1 else cut(kept)
    return docs
