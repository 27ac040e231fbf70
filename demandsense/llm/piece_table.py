"""Fill-in-middle by piece table.

A document is never copied: it is a list of pieces (buffer, start, end) over immutable buffers, the text's own bytes
and one buffer with the three sentinels.  Cutting splits pieces, a form is a permutation of them with sentinels set
in, and restoring finds the sentinels in the arranged pieces, cuts them out and applies the inverse permutation.  Text
or digest are taken by walking the pieces.

The middle is drawn from the SHA-256 of a seed and the document's id, so it depends on nothing else.  Texts that hold a
sentinel stay plain, so the first sentinel found in an arranged text is always a real one: no sentinel can arise
where a piece meets a sentinel, as each begins with the only ``<`` it has.

Defined results: a null or empty text is plain and empty; a null id draws from the empty string; rows with one id are
cut alike, in proportion to their own lengths; repeated rows stay repeated; other columns are kept by ``arranged`` and
``restored``, where columns named like the results are replaced.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.llm.shipping import by_value

by_value(__name__)

SEED = "1"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred documents, how many are rearranged, and how many of those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20

# The sentinels, and what each form writes in which order (P, S, M: sentinels; 0, 1, 2: prefix, middle, suffix).
SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FORMS = {PSM: ("P", 0, "S", 2, "M", 1), SPM: ("S", 2, "P", 0, "M", 1)}

MARKS = b"".join(SENTINELS.values())
BLOCK = 1 << 20

DIGESTS = T.StructType([T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])


class Piece(NamedTuple):
    buffer: bytes
    start: int
    end: int

    @property
    def size(self) -> int:
        return self.end - self.start


Pieces = list[Piece]


def byte_offset(text: bytes, chars: int) -> int:
    """Where the code point number ``chars`` begins; blocks of the text are counted one after the other."""
    if text.isascii():
        return chars
    for at in range(0, len(text), BLOCK):
        starts = (np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at) & 0xC0) != 0x80
        here = int(np.count_nonzero(starts))
        if chars < here:
            return at + int(np.flatnonzero(starts)[chars])
        chars -= here
    return len(text)


def split(pieces: Pieces, *offsets: int) -> list[Pieces]:
    """Parts of ``pieces`` between ascending byte offsets."""
    parts: list[Pieces] = [[]]
    left, at = list(offsets), 0
    for piece in pieces:
        while left and left[0] <= at + piece.size:
            cut = piece.start + left.pop(0) - at
            parts[-1].append(Piece(piece.buffer, piece.start, cut))
            parts.append([])
            at, piece = at + cut - piece.start, Piece(piece.buffer, cut, piece.end)
        parts[-1].append(piece)
        at += piece.size
    return [[p for p in part if p.size] for part in parts]


def mark(name: str) -> Piece:
    start = MARKS.index(SENTINELS[name])
    return Piece(MARKS, start, start + len(SENTINELS[name]))


def arrange(pieces: Pieces, form: str, prefix: int, middle: int) -> Pieces:
    """The pieces of the output: prefix and middle end at these byte offsets."""
    if form == PLAIN:
        return pieces
    parts = split(pieces, prefix, middle)
    out: Pieces = []
    for step in FORMS[form]:
        out += [mark(step)] if isinstance(step, str) else parts[step]
    return out


def blocks(pieces: Iterable[Piece]) -> Iterator[memoryview]:
    """The bytes of the pieces in order, in views of bounded size."""
    for piece in pieces:
        for at in range(piece.start, piece.end, BLOCK):
            yield memoryview(piece.buffer)[at: min(at + BLOCK, piece.end)]


def find(pieces: Pieces, wanted: bytes, begin: int = 0) -> int:
    """Byte offset of the first ``wanted`` at or after ``begin``, found also where pieces meet."""
    at, tail = 0, b""
    for view in blocks(pieces):
        if at + len(view) > begin:
            seen = tail + bytes(view[max(0, begin - at):])
            place = seen.find(wanted)
            if place >= 0:
                return at + len(view) - len(seen) + place
            tail = seen[max(0, len(seen) - len(wanted) + 1):]
        at += len(view)
    raise ValueError(f"no {wanted!r} in the text")


def restore(pieces: Pieces, form: str) -> Pieces:
    """The pieces of the original, from those of the output and its form alone."""
    if form == PLAIN:
        return pieces
    cuts, at = [], 0
    for step in FORMS[form]:
        if isinstance(step, str):
            at = find(pieces, SENTINELS[step], at)
            cuts += [at, at + len(SENTINELS[step])]
            at = cuts[-1]
    parts = split(pieces, *cuts)[1:]  # nothing stands before the first sentinel
    back = {step: parts[k] for k, step in enumerate(FORMS[form]) if isinstance(step, int)}
    return [piece for k in sorted(back) for piece in back[k]]


def sha256(pieces: Pieces) -> str:
    digest = hashlib.sha256()
    for view in blocks(pieces):
        digest.update(view)
    return digest.hexdigest()


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """The documents' ``id``, ``body`` (text, never null), ``n``, ``form``, ``lo``, ``hi`` (code points) and ``row`` (all columns)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(doc_id), seed))])
    n = F.length("body").cast("long")
    plain = (n == 0) | (F.col("h2") % 100 >= REARRANGED)
    for sentinel in SENTINELS.values():
        plain = plain | F.contains("body", F.lit(sentinel.decode()))
    a, b = F.col("h0") % (n + 1), F.col("h1") % (n + 1)
    form = F.when(plain, PLAIN).when(F.col("h3") % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)
    return rows.select("row", "id", "body", n.alias("n"), form.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _output(body: bytes, form: str, lo: int, hi: int) -> Pieces:
    return arrange([Piece(body, 0, len(body))], form, *([0, 0] if form == PLAIN else [byte_offset(body, lo), byte_offset(body, hi)]))


def _each(value: Callable[..., object], kind: pa.DataType):
    """An Arrow function that takes one text at a time."""
    def run(body: pa.Array, *rest: pa.Array) -> pa.Array:
        return pa.array((value(t.as_py() or b"", *(r.as_py() for r in row)) for t, *row in zip(body.cast(pa.binary()), *rest)), kind)
    return run


def _texts(body: pa.Array, form: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    return _each(lambda *row: b"".join(blocks(_output(*row))), pa.binary())(body, form, lo, hi).cast(pa.string())


def _digests(body: pa.Array, form: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    def both(t: bytes, f: str, a: int, b: int) -> dict[str, str]:
        out = _output(t, f, a, b)
        return {"output_sha256": sha256(out), "restored_sha256": sha256(restore(out, f))}
    return _each(both, pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())]))(body, form, lo, hi)


def _originals(output: pa.Array, form: pa.Array) -> pa.Array:
    return _each(lambda t, f: b"".join(blocks(restore([Piece(t, 0, len(t))], f or PLAIN))), pa.binary())(output, form).cast(pa.string())


def arranged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``form`` and ``output``, the rearranged text."""
    out = planned(docs, doc_id, text, seed).select("row", "form", F.arrow_udf(_texts, T.StringType())("body", "form", "lo", "hi").alias("output"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("form", "output")], "form", "output")


def restored(rows: DataFrame, form: str = "form", output: str = "output", name: str = "text") -> DataFrame:
    """``rows`` with the original text rebuilt from ``output`` and ``form``; a null output is an empty text, a null form plain."""
    return rows.withColumn(name, F.arrow_udf(_originals, T.StringType())(F.col(output), F.col(form)))


def fim_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Form, cuts and the digests of output and restored text, one row per document."""
    rows = planned(docs, seed=seed).select("id", "n", "form", "lo", "hi", F.arrow_udf(_digests, DIGESTS)("body", "form", "lo", "hi").alias("digest"))
    moved = F.col("form") != PLAIN
    return rows.select(F.col("id").alias("doc_id"), "n", "form", F.when(moved, F.col("lo")).alias("prefix_chars"), F.when(moved, F.col("hi") - F.col("lo")).alias("middle_chars"), "digest.*")
