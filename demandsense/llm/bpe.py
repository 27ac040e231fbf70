"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut where no piece of the pre-splitting pattern can reach across: between a letter or digit and a
blank, or, in a text without blanks, between an ASCII letter and an ASCII digit.  A stretch without such a place is
encoded whole.  Ids are decoded to raw bytes, so ids that end in the middle of a character decode too.

Texts are encoded, decoded and compared in one pass, one text at a time, and leave the task in slices of about ``OUT_BYTES``.
The ranks are read once on the driver and sent to the executors (a fixed file, under a megabyte).

Defined results: a null or empty text has no ids and decodes to no bytes; strings of special tokens are ordinary
text; repeated rows are encoded each on its own; extra columns are kept, those named like the results replaced.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from demandsense.llm.shipping import by_value

by_value(__name__)

STRETCH = 1 << 15
OUT_BYTES = 4 << 20
AT_BLANK = re.compile(r"(?<=[^\W_])(?=[ \n])")
AT_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> Iterator[str]:
    """Parts of ``text`` that can be encoded one by one."""
    at = 0
    while len(text) - at > STRETCH:
        place = AT_BLANK.search(text, at + STRETCH) or AT_DIGIT.search(text, at + STRETCH)
        if place is None:
            break
        yield text[at: place.start()]
        at = place.start()
    yield text[at:]


def encoded(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    ids = [np.asarray(enc.encode_ordinary(part), np.int32) for part in stretches(text)]
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


Coded = Callable[[tiktoken.Encoding, Any], dict[str, Any]]


def _mapper(ranks, pattern: str, column: int, kept: list[int], value: Coded, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        names = schema.names[len(kept):]
        for batch in batches:
            begin, size, rows = 0, 0, []
            for i in range(batch.num_rows):  # one cell at a time, slices of bounded size out
                rows.append(value(enc, batch.column(column)[i]))
                size += sum(getattr(v, "nbytes", len(v) if isinstance(v, (bytes, str)) else 8) for v in rows[-1].values())
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    made = [pa.array([r[n] for r in rows], schema.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, i + 1 - begin) for k in kept], *made], schema=schema)
                    begin, size, rows = i + 1, 0, []
    return run


def _mapped(rows: DataFrame, column: str, path: str, pattern: str, value: Coded, added: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` and ``added``, made from ``column`` in one pass."""
    new = T._parse_datatype_string(added).fields
    keep = [c for c in keep if c not in {f.name for f in new}]
    given = rows.select(*keep, F.col(column).alias("__cell"))
    out = T.StructType([given.schema[c] for c in keep] + new)
    ranks = rows.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    return given.mapInArrow(_mapper(ranks, pattern, len(keep), list(range(len(keep))), value, to_arrow_schema(out)), out)


def _ids(enc: tiktoken.Encoding, text: pa.Scalar) -> np.ndarray:
    return encoded(enc, text.as_py()) if text.is_valid else np.empty(0, np.int32)


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` and array<int> ``ids`` of each whole text."""
    return _mapped(docs, text, path, pattern, lambda enc, t: {"ids": _ids(enc, t)}, "ids array<int>", docs.columns)


def with_bytes(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` and the bytes (``decoded``) that ``ids`` stand for; a null list stands for none."""
    return _mapped(rows, ids, path, pattern, lambda enc, x: {"decoded": enc.decode_bytes(x.as_py() or [])}, "decoded binary", rows.columns)


def with_checked_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs``, ``ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to the text's bytes."""
    def value(enc: tiktoken.Encoding, t: pa.Scalar) -> dict[str, Any]:
        ids = _ids(enc, t)
        return {"ids": ids, "n_tokens": len(ids), "round_trip": enc.decode_bytes(ids.tolist()) == (t.as_py() or "").encode()}
    return _mapped(docs, text, path, pattern, value, "ids array<int>, n_tokens long, round_trip boolean", docs.columns)


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of the ids and of what they decode to, one row per document."""
    def value(enc: tiktoken.Encoding, t: pa.Scalar) -> dict[str, Any]:
        ids = _ids(enc, t).tolist()
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                "decoded_sha256": hashlib.sha256(enc.decode_bytes(ids)).hexdigest()}
    return _mapped(docs, "text", path, pattern, value, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
