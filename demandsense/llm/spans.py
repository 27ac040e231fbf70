"""Column helpers for text spans: regex matches with code point positions, in Spark expressions only."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(lengths: Column) -> Column:
    """Inclusive running sums of an integer array, by chunks so that long arrays stay near linear."""
    def chunks_of(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / CHUNK).cast("int")
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(
            F.slice(F.array(a), 1, 0))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def spread(chunks: Column, sums: Column) -> Column:
        def one(chunk: Column, k: Column) -> Column:
            return let(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(chunk, lambda _, i: base + total(F.slice(chunk, F.lit(1), i + 1))))
        return F.flatten(F.transform(chunks, one))

    return let(lengths, lambda a: let(chunks_of(a), lambda c: let(F.transform(c, total), lambda s: spread(c, s))))


def spans(text: Column, pattern: str, kind: str, rank: int, around: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, rank, end, kind, value, before, after>>.

    ``start`` and ``end`` are code points, end exclusive.  ``before`` and ``after`` are up to ``around``
    characters next to the match, not reaching into a neighbouring match.  A text without a match costs one scan.
    """
    pat = F.lit(pattern)

    def build(s: Column) -> Column:
        m, gap = s["m"], s["gap"]
        ends = running_sum(F.transform(m, lambda x, i: F.length(F.get(gap, i)) + F.length(x)))
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.lit(rank).alias("rank"), F.get(e, i).alias("end"), F.lit(kind).alias("kind"), x.alias("value"),
            (F.right(F.get(gap, i), F.lit(around)) if around else F.lit("")).alias("before"),
            (F.left(F.get(gap, i + 1), F.lit(around)) if around else F.lit("")).alias("after"))))

    found = let(F.struct(F.regexp_extract_all(text, pat, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), build)
    return F.when(F.regexp_like(text, pat), found).otherwise(F.slice(F.transform(F.array(F.lit("")), lambda x: F.struct(
        F.lit(0).alias("start"), F.lit(rank).alias("rank"), F.lit(0).alias("end"), F.lit(kind).alias("kind"), x.alias("value"), x.alias("before"), x.alias("after"))), 1, 0))


def in_order(parts: Sequence[Column]) -> Column:
    """All spans by start, then rank, then end."""
    return F.array_sort(F.concat(*parts))


def written(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def replaced(text: Column, found: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted, merged where they overlap) replaced by ``label(span)``; linear in the text.

    Cuts are made in UTF-32, where a code point has a fixed width.
    """
    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    def build(spans_: Column) -> Column:
        def piece(wide: Column, length: Column) -> Column:
            def at(s: Column, i: Column) -> Column:
                begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans_, i - 1)["end"])
                return F.concat(F.decode(F.substring(wide, begin * 4 + 1, (s["start"] - begin) * 4), "UTF-32"), s["label"])
            tail = F.element_at(spans_, -1)["end"]
            return F.concat(F.array_join(F.transform(spans_, at), ""), F.decode(F.substring(wide, tail * 4 + 1, (length - tail) * 4), "UTF-32"))
        return let(F.encode(text, "UTF-32"), lambda w: piece(w, F.length(text)))

    slim = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    merged = F.aggregate(slim, F.slice(slim, 1, 0), merge)
    return F.when(F.size(found) > 0, let(merged, build)).otherwise(text)
