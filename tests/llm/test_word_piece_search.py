"""Fill-in-middle, BPE by distinct words, ranked search: against the libraries and brute force, on awkward texts."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from demandsense.llm import best_positions, piece_table, word_table

RNG = random.Random(11)
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LONG = " ".join("".join(RNG.choice("abcdeéü日") for _ in range(RNG.randint(1, 9))) for _ in range(20_000))
TEXTS = [None, "", " ", "\n\n \t x", "plain words only", "it's we'LL they've 12 3four ½ ²  　 x", "é😀 naïve 日本語 ́a ք֏ \U0001f600\U0001f600", "a <|endoftext|> b<|endoftext|><|endoftext|>\n <|endoftext|",
         "has <P> inside", "<S", "<<P", "x" * 50_000, " " * 5_000 + "y", "-" * 3_000 + "ab1" * 2_000, LONG, "the cat sat on the mat", "The CAT; cat, dog_7 dog", "na\x00ul � ​\x7f", "9" * 500]


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(documents):
    return documents([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (4, TEXTS[14]), (None, TEXTS[4])])


def text_of(r) -> list:
    return [t or "" for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (4, TEXTS[14]), (None, TEXTS[4])] if i == r.doc_id]


# ------------------------------------------------------------------ fill in the middle
def fim(doc_id, t):
    """(form, prefix, middle, output) by slicing."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, t
    if h4 % 100 < 20:
        return "spm", lo, hi - lo, f"<S>{t[hi:]}<P>{t[:lo]}<M>{t[lo:hi]}"
    return "psm", lo, hi - lo, f"<P>{t[:lo]}<S>{t[hi:]}<M>{t[lo:hi]}"


def test_fill_in_middle_equals_slicing(documents):
    texts = TEXTS * 12  # enough ids for each form and empty parts
    got = piece_table.fim_report(documents([*enumerate(texts), (3, "other"), (None, "no id")])).collect()
    want = []
    for i, t in [*enumerate(texts), (3, "other"), (None, "no id")]:
        t = t or ""
        form, prefix, middle, out = fim(i, t)
        want.append((i, len(t), form, prefix, middle, sha(out), sha(t)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_round_trip_keeps_columns(rows):
    out = piece_table.arranged(rows)
    assert out.columns == [*rows.columns, "form", "output"] and out.count() == rows.count()
    back = piece_table.restored(out.drop("text"))
    assert sorted(t for r in out.select("doc_id").distinct().collect() for t in text_of(r)) == sorted(r.text for r in back.collect())
    odd = rows.sparkSession.createDataFrame([(None, None), (None, "x")], "form string, output string")
    assert sorted(r.text for r in piece_table.restored(odd).collect()) == ["", "x"]


def test_pieces_at_any_cut():
    text = "aé<😀P>".encode()
    whole = [piece_table.Piece(text, 0, 2), piece_table.Piece(text, 2, len(text))]
    for form in (piece_table.PSM, piece_table.SPM):
        for lo in range(len(text) + 1):
            for hi in range(lo, len(text) + 1):
                out = piece_table.arrange(whole, form, lo, hi)
                assert b"".join(piece_table.blocks(piece_table.restore(out, form))) == text
                assert sum(p.size for p in out) == len(text) + 9 and all(p.buffer in (text, piece_table.MARKS) for p in out)


def test_sentinel_found_where_pieces_meet(monkeypatch):
    monkeypatch.setattr(piece_table, "BLOCK", 2)
    parts = [piece_table.Piece(b, 0, len(b)) for b in (b"ab<", b"<", b"P", b">c<P>")]
    assert piece_table.find(parts, b"<P>") == 3 and piece_table.find(parts, b"<P>", 4) == 7
    assert [piece_table.byte_offset("aéb😀c".encode(), k) for k in range(6)] == [0, 1, 3, 4, 8, 9]
    with pytest.raises(ValueError):
        piece_table.find(parts, b"<M>")


# ------------------------------------------------------------------ BPE by distinct words
@pytest.mark.parametrize("section", [1 << 21, 64])
def test_word_table_equals_the_library(rows, monkeypatch, section):
    monkeypatch.setattr(word_table, "SECTION", section)
    monkeypatch.setattr(word_table, "ROW_WORDS", 50)
    monkeypatch.setattr(word_table, "BUCKET", 5 * section)
    got = word_table.code_report(rows, PATH).collect()
    assert len(got) == len(TEXTS) + 3
    have = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    want = Counter()
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (4, TEXTS[14]), (None, TEXTS[4])]:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))] += 1
    assert have == want


def test_words_are_the_librarys(spark):
    split = word_table.Words(LIBRARY.to_str())
    alphabet = [chr(c) for c in range(0x250)] + ["'", " ", " ", "\n", "s", "ll", "1"] * 40
    for _ in range(2_000):
        text = "".join(RNG.choices(alphabet, k=RNG.randint(1, 12)))
        assert list(split(text)) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_each_word_is_encoded_once_in_the_bucket_that_has_it(spark, monkeypatch):
    monkeypatch.setattr(word_table, "BUCKET", 40)
    words = [f"w{k}" for k in range(60)] + ["日本", " the", "\n\n", "a\x00b"]
    asked = [(s, 7 * s, RNG.sample(words, 30)) for s in range(9)]
    page = word_table.page_size(PATH)
    assert 50_257 / 63 <= page < 50_257 / 62
    rows = word_table.section_ids(spark.createDataFrame(asked, "section long, first int, words array<string>").repartition(3), PATH)
    found = {}
    for r in rows.collect():
        number, size, ids = (word_table.unpacked(r[k]).tolist() for k in ("asked", "sizes", "ids"))
        assert {p for p in range(63) if r.pages >> p & 1} == {x // page for x in ids} and sum(size) == len(ids)
        for n, k in zip(number, size):
            found[r.section, n] = [ids.pop(0) for _ in range(k)]
    assert found == {(s, first + i): LIBRARY.encode(w, add_special_tokens=False).ids for s, first, ws in asked for i, w in enumerate(ws)}

    class Counting:
        seen = Counter()

        def encode_batch(self, texts, add_special_tokens):
            self.seen.update(texts)
            return LIBRARY.encode_batch(texts, add_special_tokens=add_special_tokens)
    monkeypatch.setattr(word_table, "plain", lambda file: Counting())
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    schemas = [to_arrow_schema(T._parse_datatype_string(x)) for x in (word_table.DEALT, word_table.ANSWERED)]
    given = word_table.pa.RecordBatch.from_pylist([dict(zip(("section", "first", "words"), r)) for r in asked])
    dealt = word_table.pa.Table.from_batches(word_table._dealing(4, schemas[0])(iter([given]))).sort_by("bucket")
    file = type("File", (), {"value": ""})
    answers = list(word_table._answering(file, page, schemas[1])(iter(dealt.to_batches())))
    assert len(answers) == dealt.num_rows and set(Counting.seen.values()) == {1} and set(Counting.seen) == {w for _, _, ws in asked for w in ws}


def test_packed_numbers():
    for numbers in ([], [0], [1, 2, 2 ** 32 - 1, 7], RNG.choices(range(2 ** 20), k=5_000)):
        assert word_table.unpacked(word_table.packed(numbers)).tolist() == numbers
    words = ["", "é", "日本 x", "a\x00b", "\U0001f600"]
    assert word_table.unpacked_words(**word_table.packed_words(words)) == words and word_table.unpacked_words(**word_table.packed_words([])) == []


def test_decoding_any_ids(spark):
    ids = [[], None, [447], [50256, 222, 50256, 447], [64, 60000, 65], list(range(0, 50257, 97)), [447] * 3]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>").repartition(3)
    got = {r.doc_id: r.decoded for r in word_table.decoded(rows, PATH, sections=4).collect()}
    assert got == {i: LIBRARY.decode([x for x in v or [] if x < 50257], skip_special_tokens=False) for i, v in enumerate(ids)}


def test_word_table_on_no_rows(documents):
    assert word_table.code_report(documents([]), PATH).collect() == []
    assert [r.decoded for r in word_table.encoded(documents([(1, None)]), PATH).collect()] == [""]


# ------------------------------------------------------------------ ranked search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def parts(text) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, parts(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = Counter()
    for item, text in dict.fromkeys(items):
        found = []
        for i, bag in bags:
            tf, score = Counter(bag), 0
            for t in set(parts(text)) & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * (50 + (50 * len(bag) * n_docs) // total)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out.update((item, rank, None if void else i, -s) for rank, (s, void, i) in enumerate(sorted(found)[:k], 1))
    return out


def corpus(n):
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "日本", "the", "The"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, RNG.choice([" ", "; "]).join(RNG.choices(vocabulary, weight, k=RNG.randint(1, 40)))) for i in range(n)]


ITEMS = [(1, "w1 w2 w3 the"), (2, None), (3, ""), (4, "nowhere"), (5, "W7, w8; w7 Été"), (6, "w50 w51 w0"), (6, "日本"), (5, "W7, w8; w7 Été"), (None, "w9"), (8, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("shard,group,k", [(1 << 13, 1 << 12, 50), (64, 8, 7), (16, 2, 3)])
def test_ranked_search_equals_brute_force(documents, monkeypatch, shard, group, k):
    monkeypatch.setattr(best_positions, "SHARD", shard)
    monkeypatch.setattr(best_positions, "GROUP", group)
    monkeypatch.setattr(best_positions, "FIRST_STEP", 2)
    docs = corpus(400) + [(7, "w1 w2"), (9, "w1 w2"), (9, "w1 w2"), (None, "w1 w2 w3"), (500, None), (501, ""), (502, "?!"), (503, "w1 " * 30_000)]
    spark = documents(docs).sparkSession
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string").repartition(2)
    got = best_positions.ranked(documents(docs), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, ITEMS, k)


def test_blocks_of_items_give_the_same(documents):
    docs = corpus(60)
    spark = documents(docs).sparkSession
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, best_positions.ranked(documents(docs), items, 5, block_bytes=20).collect())) == brute(docs, ITEMS, 5)


def test_search_on_empty_tables(documents):
    spark = documents([]).sparkSession
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert best_positions.ranked(documents([]), items).collect() == []
    assert best_positions.ranked(documents(corpus(5)), items.limit(0)).collect() == []


def test_reading_stops_early_and_strictly_below():
    n, rng = 4_000, np.random.default_rng(3)
    term = np.repeat([0, 1], n)
    doc = np.concatenate([np.arange(n)] * 2)
    impact = np.concatenate([np.sort(rng.integers(1, 10**6, n))[::-1]] * 2)  # both lists agree: the best stand on top
    shard = best_positions.Shard(term, doc, impact, 2, n)
    lists = np.array([0, 1])
    top = best_positions.Top(5)
    assert best_positions.search(shard, lists, shard.places(lists), np.arange(n), np.zeros(n, bool), top) < 100
    assert top.id.tolist() == [0, 1, 2, 3, 4] and (top.score == 2 * impact[:5]).all()
    # all scores equal: no sum is strictly below the k-th, so every document is looked up and the least ids win
    flat = best_positions.Shard(np.zeros(n, int), rng.permutation(n), np.full(n, 7), 1, n)
    top = best_positions.Top(3)
    assert best_positions.search(flat, lists[:1], flat.places(lists[:1]), np.arange(n), np.zeros(n, bool), top) == n
    assert top.id.tolist() == [0, 1, 2]
