"""BPE by a distinct-word table, with a tokenizer file of the tokenizers library.

Texts are split into the words that the tokenizer merges within.  Documents are dealt to sections of about ``SECTION``
words; in a section each distinct word gets a number and a document becomes the list of its words' numbers, written
once.  The sections' distinct words go, packed, to the bucket of the word table that their hash names; a bucket encodes
each distinct word once, whichever sections ask for it, and sends every section the ids of its words; a document's ids
are put together by position.  Ids are decoded through a join with the vocabulary's pieces, by the pages of ids that a
section uses.  So a word costs one encoding however often it occurs, and what is shuffled is numbers, distinct words and
distinct ids, never occurrences of words.

Documents stay where they were written, in files by section, so only their words and ids are shuffled.

Where all characters of a text lie below ``COMMON``, one regular expression splits it; its character classes are
asked of the library itself.  Other texts are split by the library.  Special tokens in a text are words of their own.

Broadcast: the vocabulary's pieces, a fixed file of bounded size.  One task holds one section (``SECTION`` words and at
most one document more, however long) or the distinct words of one bucket (``BUCKET`` in expectation): the number of
buckets follows from the number of words that the sections ask for.

Defined results: a null or empty text has no ids and decodes to the empty text; ids that are not in the vocabulary
decode to nothing; bytes that are not UTF-8 decode to U+FFFD as the library does it; repeated rows are coded each on its
own; columns other than those named are ignored.
"""
from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from demandsense.functions.lineage import checkpoint_dir, cut
from demandsense.llm.shipping import by_value

by_value(__name__)

SECTION = 1 << 21
#: Distinct words in one row of the list of a section's words.
ROW_WORDS = 1 << 17
#: Words encoded by one call of the library; words of sections that a bucket answers, in expectation.
CALL_WORDS, BUCKET = 1 << 12, 1 << 18
#: The vocabulary is parted into so many pages; those that a section uses fit one number, a bit each.
PAGES = 63
COMMON = 0x250
OUT_BYTES = 4 << 20

DEALT = "bucket long, section long, asked binary, sizes binary, chars binary"
ANSWERED = "section long, asked binary, sizes binary, ids binary, pages long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones themselves, the rest from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


BYTE_OF = _byte_of()


class Words:
    """Splits texts as the tokenizer does."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.special = [t["content"] for t in json.loads(file)["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds: dict[str, list[str]] = {"letter": [], "digit": [], "sign": [], "space": []}
        for c in map(chr, range(COMMON)):
            kinds[next((k for k, probe in (("letter", "a"), ("digit", "1"), ("sign", "-")) if len(self._parts(probe + c)) == 1), "space")].append(c)
        letter, digit, sign, space = ("".join(map(re.escape, kinds[k])) for k in ("letter", "digit", "sign", "space"))
        self.common = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[{sign}]+|[{space}]+(?![{letter}{digit}{sign}])|[{space}]+")
        self.uncommon = re.compile(f"[^{chr(0)}-{chr(COMMON - 1)}]")

    def _parts(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> Iterable[str]:
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                yield part
            elif part:
                yield from self._parts(part) if self.uncommon.search(part) else self.common.findall(part)


def packed(numbers: Sequence[int] | np.ndarray) -> bytes:
    """Compressed byte by byte: the high bytes of most numbers are alike."""
    return zstandard.compress(np.ascontiguousarray(np.asarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def packed_words(words: Sequence[str]) -> dict[str, bytes]:
    return {"sizes": packed(list(map(len, words))), "chars": zstandard.compress("".join(words).encode())}


def unpacked_words(sizes: bytes, chars: bytes) -> list[str]:
    text = zstandard.decompress(chars).decode()
    ends = np.cumsum(unpacked(sizes).astype(np.int64)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _numbering(file, sections_of: Callable[[], int], key: pa.Schema):
    """Rows of documents (key, section, numbers) and of sections (section, first, words)."""
    schema = pa.schema([*key, ("section", pa.int64()), ("numbers", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(file.value)
        section, number, held = sections_of(), {}, 0

        def words() -> Iterator[pa.RecordBatch]:
            known = list(number)
            for at in range(0, len(known), ROW_WORDS):
                row = {"section": section, "first": at, "words": known[at: at + ROW_WORDS]}
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            rows, size = [], 0
            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):  # one text at a time
                found = [number.setdefault(w, len(number)) for w in split(texts[i].as_py() or "")]
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(key.names)}
                rows.append(row | {"section": section, "numbers": packed(found)})
                held += len(found)
                size += len(rows[-1]["numbers"])
                full = held >= SECTION
                if full or size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
                if full:
                    yield from words()
                    section, number, held = sections_of(), {}, 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        yield from words()
    return run


def _new_section() -> int:
    """A number that no other section has: sections are written once, so it need not be the same in another run."""
    return uuid.uuid4().int >> 65


def encode(tokenizer: Tokenizer, words: Sequence[str]) -> Iterator[list[int]]:
    for at in range(0, len(words), CALL_WORDS):
        for coded in tokenizer.encode_batch(words[at: at + CALL_WORDS], add_special_tokens=False):
            yield coded.ids


def by_bucket(words: Sequence[str], first: int, buckets: int) -> dict[int, tuple[list[int], list[str]]]:
    """The words of a section's row, numbered from ``first``, by the bucket of the word table that has them."""
    out: dict[int, tuple[list[int], list[str]]] = {}
    for number, word in enumerate(words, first):
        numbers, asked = out.setdefault(xxhash.xxh64_intdigest(word) % buckets, ([], []))
        numbers.append(number)
        asked.append(word)
    return out


def _dealing(buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, first, words in zip(*(batch.column(k) for k in range(3))):
                dealt = by_bucket(words.as_py(), first.as_py(), buckets)
                yield pa.RecordBatch.from_pylist([{"bucket": b, "section": section.as_py(), "asked": packed(n), **packed_words(w)} for b, (n, w) in dealt.items()], schema)
    return run


def _answering(file, page: int, schema: pa.Schema):
    """Rows ordered by bucket: each distinct word of a bucket is encoded when it is first asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = plain(file.value)
        bucket, ids_of = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                own, section, asked, sizes, chars = (batch.column(k)[row].as_py() for k in range(5))
                if own != bucket:
                    bucket, ids_of = own, {}
                words = unpacked_words(sizes, chars)
                unknown = [w for w in words if w not in ids_of]
                ids_of.update(zip(unknown, (np.array(i, np.uint32) for i in encode(tokenizer, unknown))))
                ids = [ids_of[w] for w in words]
                flat = np.concatenate(ids)
                used = sum(1 << p for p in np.unique(flat // page).tolist())
                yield pa.RecordBatch.from_pylist([{"section": section, "asked": asked, "sizes": packed(list(map(len, ids))), "ids": packed(flat), "pages": used}], schema)
    return run


def plain(file: str) -> Tokenizer:
    """The tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_str(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def pieces(path: str) -> Iterator[tuple[int, bytes]]:
    """The bytes of every id of the vocabulary."""
    for token, number in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items():
        known = all(c in BYTE_OF for c in token)
        yield number, bytes(BYTE_OF[c] for c in token) if known else token.encode()


def page_size(path: str) -> int:
    return max(1, math.ceil((max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1) / PAGES))


def section_ids(words: DataFrame, path: str) -> DataFrame:
    """section, asked (numbers of words), sizes, ids, pages: the ids of each section's distinct ``words`` (section, first, words), by way of the word table."""
    asked = words.agg(F.sum(F.size("words").cast("long")).alias("n")).first()["n"] or 0
    dealt, answered = T._parse_datatype_string(DEALT), T._parse_datatype_string(ANSWERED)
    buckets = max(1, math.ceil(asked / BUCKET))
    by = words.select("section", "first", "words").mapInArrow(_dealing(buckets, to_arrow_schema(dealt)), dealt).repartition("bucket").sortWithinPartitions("bucket")
    return by.mapInArrow(_answering(_file(words.sparkSession, path), page_size(path), to_arrow_schema(answered)), answered)


class Dictionary:
    """The ids of each word of a section, by the word's number."""

    def __init__(self, rows: Iterable[tuple[bytes, bytes, bytes]]):
        parts = [tuple(map(unpacked, row)) for row in rows]
        number, size, self.flat = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in (list(zip(*parts)) or [()] * 3))
        size = size.astype(np.int64)
        self.start, self.size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        self.start[number], self.size[number] = np.cumsum(size) - size, size

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[numbers] - before, size) + np.arange(int(size.sum()))]


def paged(used: DataFrame, path: str) -> DataFrame:
    """section, page_ids, page_sizes, page_bytes: the ids and pieces of the vocabulary's pages that a section uses, from ``used`` (section, page)."""
    spark, size = used.sparkSession, page_size(path)
    pages: dict[int, list[tuple[int, bytes]]] = {}
    for number, piece in pieces(path):
        pages.setdefault(number // size, []).append((number, piece))
    rows = [(page, packed([i for i, _ in own]), packed([len(x) for _, x in own]), zstandard.compress(b"".join(x for _, x in own))) for page, own in sorted(pages.items())]
    table = spark.createDataFrame(rows, "page int, page_ids binary, page_sizes binary, page_bytes binary")
    return used.distinct().join(F.broadcast(table), "page").drop("page")


def _pieces_of(right: pa.Table) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    for page in right.select(["page_ids", "page_sizes", "page_bytes"]).to_pylist():
        text, ends = zstandard.decompress(page["page_bytes"]), np.cumsum(unpacked(page["page_sizes"]).astype(np.int64)).tolist()
        out.update(zip(unpacked(page["page_ids"]).tolist(), (text[a:b] for a, b in zip([0, *ends], ends))))
    return out


Finish = Callable[[list[int], bytes], dict]


def _coding(keys: Sequence[str], finish: Finish, schema: pa.Schema):
    """Ids by position from a section's words, decoded by its pieces."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.filter(right.column("asked").is_valid()).select(["asked", "sizes", "ids"])
        known = Dictionary(tuple(r.values()) for r in answers.to_pylist())
        of_id = _pieces_of(right.filter(right.column("page_ids").is_valid()))
        out, size, parts = [], 0, []
        for i in range(left.num_rows):
            ids = known.ids(unpacked(left.column("numbers")[i].as_py())).tolist()
            out.append({k: left.column(k)[i].as_py() for k in keys} | finish(ids, b"".join(map(of_id.__getitem__, ids))))
            size += len(ids)
            if size >= OUT_BYTES or i + 1 == left.num_rows:
                parts.append(pa.Table.from_pylist(out, schema))
                out, size = [], 0
        return pa.concat_tables(parts) if parts else schema.empty_table()
    return run


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` written in buckets by section; each task holds few sections, so it writes few files and nothing is shuffled.

    Buckets need a name in the session's catalog; the files lie in the shared folder and, like other cut tables, are left to the
    cluster's clean-up.
    """
    spark = rows.sparkSession
    name = f"sections_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "section").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def coded(docs: DataFrame, path: str, finish: Finish, added: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and what ``finish(ids, decoded bytes)`` makes of each whole text (columns ``added``)."""
    spark = docs.sparkSession
    file = _file(spark, path)
    kept = docs.select(*keys).schema
    body = T.StructType(kept.fields + T._parse_datatype_string("section long, numbers binary, first int, words array<string>").fields)
    table = _bucketed(docs.select(*keys, text).mapInArrow(_numbering(file, _new_section, to_arrow_schema(kept)), body), _buckets(spark))
    answers = cut(section_ids(table.where("words is not null"), path))
    used = answers.groupBy("section").agg(F.bit_or("pages").alias("pages"))
    page = F.explode(F.filter(F.sequence(F.lit(0), F.lit(PAGES - 1)), lambda p: F.call_function("getbit", F.col("pages"), p) == 1)).alias("page")
    right = answers.drop("pages").unionByName(paged(used.select("section", page), path), allowMissingColumns=True)
    left = table.where("numbers is not null").select(*keys, "section", "numbers")
    out = T.StructType(kept.fields + T._parse_datatype_string(added).fields)
    return left.groupBy("section").cogroup(right.groupBy("section")).applyInArrow(_coding(list(keys), finish, to_arrow_schema(out)), out)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encoded(docs: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` and ``decoded``, the text that the ids give."""
    return coded(docs, path, lambda ids, data: {"ids": ids, "decoded": data.decode("utf-8", "replace")}, "ids array<int>, decoded string", keys, text)


def _spelling(keys: Sequence[str], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_id = _pieces_of(right)
        out = []
        for i in range(left.num_rows):
            ids = left.column("given")[i].as_py() or []
            out.append({k: left.column(k)[i].as_py() for k in keys} | {"decoded": b"".join(of_id.get(x, b"") for x in ids).decode("utf-8", "replace")})
        return pa.Table.from_pylist(out, schema)
    return run


def decoded(rows: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), sections: int = 1 << 12) -> DataFrame:
    """``keys`` and ``decoded`` of any rows with ``ids``, in ``sections`` sections, through the same join with the pieces."""
    spark = rows.sparkSession
    left = cut(rows.select(*keys, F.col("ids").alias("given"), F.pmod(F.xxhash64("ids"), F.lit(sections)).alias("section")))
    used = left.select("section", F.explode(F.array_distinct(F.transform("given", lambda x: F.floor(x / page_size(path)).cast("int")))).alias("page"))
    right = paged(used, path).withColumnRenamed("section", "part")
    out = T.StructType(rows.select(*keys).schema.fields + [T.StructField("decoded", T.StringType())])
    run = _spelling(list(keys), to_arrow_schema(out))
    return left.groupBy("section").cogroup(right.groupBy("part")).applyInArrow(run, out)


class Decimals(dict):
    """Ids as decimal numbers, each written once."""

    def __missing__(self, number: int) -> str:
        text = self[number] = str(number)
        return text


DECIMAL = Decimals()


def _digest(ids: list[int], data: bytes) -> dict:
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(DECIMAL.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest()}


def code_report(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of the ids and of the text they decode to, one row per document."""
    return coded(docs, path, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
