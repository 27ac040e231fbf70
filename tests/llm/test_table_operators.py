"""SimHash, decontamination, chat format, URL filter, fixity audit and bin packing: against brute force, on awkward tables."""
import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from demandsense.llm import binpack, chat, decontaminate, fixity, simhash, url_filter

RNG = random.Random(9)


def sentence(n, rng=RNG):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


# --- SimHash


def near_texts():
    base = [sentence(n) for n in (300, 400, 80, 5, 2, 1)]
    out = [None, "", " \n", *base]
    for b in base[:3]:
        words = b.split()
        for _ in range(12):
            at = RNG.randrange(len(words))
            out.append(" ".join(words[:at] + ["changed"] + words[at + 1:]))
    return out + base + [b.upper() for b in base]


def test_simhash_components(documents):
    texts = near_texts()
    docs = documents([(100 + i, t) for i, t in enumerate(texts)] + [(102, texts[2]), (None, texts[3])])
    got = simhash.components(docs).collect()
    assert len(got) == len(texts) + 2
    prints = [brute.fingerprint(t or "") for t in texts]
    root = brute.classes(prints, simhash.RADIUS)
    for r in got:
        i = 3 if r.doc_id is None else r.doc_id - 100
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", 100 + root[i])
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({100 + x for x in root})


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2 ** 63, n // 6, dtype=np.uint64)
    f = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        f = f ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(f)


def same_classes(f, root):
    x = np.bitwise_count(f[:, None] ^ f[None, :]) <= simhash.RADIUS
    a, b = np.nonzero(np.triu(x, 1))
    assert np.array_equal(simhash.roots(len(f), a, b), root)


def test_shard_links_are_exact():
    f = clustered(3000, 1)
    same_classes(f, simhash.shard_links(f))
    ball = np.unique(f[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))[None, :])
    same_classes(ball, simhash.shard_links(ball))  # no vantage point parts it


def test_linked_fingerprints_meet_in_a_shard():
    f = clustered(4000, 2)
    tree = simhash.build_tree(f[::3], 40)
    assert tree.shards > 16
    row, shard = simhash.route(tree, f)
    where = [set() for _ in f]
    for r, s in zip(row, shard):
        where[r].add(int(s))
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1))
    assert len(a) > 500 and all(where[i] & where[j] for i, j in zip(a, b)) and all(where)


@pytest.mark.parametrize("dense", [False, True])
def test_links_over_many_shards(spark, monkeypatch, dense):
    f = clustered(1500, 3)
    if dense:
        flips = np.uint64(1) << np.arange(64, dtype=np.uint64)
        f = np.unique(np.concatenate([f, np.unique(f[5] ^ flips[:, None] ^ flips[None, :]), f[5] ^ flips[0] ^ flips[1] ^ flips[2:]]))
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "SAMPLE_LEAST", 10 ** 6)
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    star = {r.u: r.v for r in simhash.contract(simhash.links(fps)).collect()}
    signed = f.view(np.int64)
    order = np.argsort(signed)
    x = np.bitwise_count(f[order][:, None] ^ f[order][None, :]) <= 2
    root = simhash.roots(len(f), *np.nonzero(np.triu(x, 1)))
    assert {int(signed[order][i]): int(signed[order][r]) for i, r in enumerate(root) if i != r} == star


def test_midpoints_find_all_links(spark):
    f = clustered(400, 4)
    got = {(r.u, r.v) for r in simhash._midpoints(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")).collect()}
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    a, b = np.array([at[u] for u, _ in got]), np.array([at[v] for _, v in got])
    same_classes(f, simhash.roots(len(f), a, b))


# --- decontamination


def test_decontamination_equals_brute_force(documents, spark):
    rng = random.Random(11)
    items = [sentence(n, rng) for n in (30, 20, 13, 12, 7, 4)] + [None, "", "!!"]
    texts = [None, "", "short"] + [sentence(120, rng) for _ in range(5)]
    for item in items[:6]:
        w = item.split()
        for k in (0, 1, 2, 3, 4, 6):
            v = list(w)
            for at in rng.sample(range(len(v)), min(k, len(v))):
                v[at] = "other"
            texts.append(sentence(10, rng) + ", " + " ".join(v).upper() + "! " + sentence(10, rng))
        texts.append(" ".join(w[: len(w) // 2]) + " " + sentence(5, rng))
        texts.append(" ".join(w[3:]) + ". " + " ".join(w))
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[8])])
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, source string")
    want = {(i, j) for i, t in enumerate(texts) for j, b in enumerate(items) if brute.overlaps(t or "", b or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert {g for g in got if g[0] is not None} == want and any(d is None for d, _ in got)
    clean = decontaminate.clean_documents(docs, bench)
    dirty = {i for i, _ in want}
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted([i for i in range(len(texts)) if i not in dirty] + [3])
    assert decontaminate.blocks_of(bench, 30)[0] > 4  # a pass for each block: the same rows, and no plan holds two blocks
    small = decontaminate.contamination(docs, bench, block_words=30)
    assert sorted(map(str, small.collect())) == sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    assert "ArrowEvalPython" not in small._jdf.queryExecution().executedPlan().toString()
    by_block = decontaminate.clean_documents(docs, bench, block_words=30)
    assert by_block.columns == docs.columns and sorted(map(str, by_block.collect())) == sorted(map(str, clean.collect()))
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_masks_cover_every_two_substitutions():
    n = decontaminate.WINDOW
    for p in range(n):
        for q in range(n):
            assert any(not {p, q} & {o + x for x in m} for m in decontaminate.MASKS for o in range(n - m[-1]))


# --- chat format

CONTROL = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>hi<|end|>", "<~|more|> <~~|end|> [~INST] <", "<<SYS>> <|", "", None, "é😀\n", "~<|end|>~", "plain", "[[INST]]"]


def test_chat_round_trip(spark):
    rows = [(1, i, RNG.choice(["user", "assistant"]), RNG.choice(CONTROL)) for i in range(600)] + [(2, 0, None, "a"), (2, 0, "user", "b"), (2, None, "assistant", "c"), (2, 0, "user", "b"),
            (3, 5, "<|end|>", "x"), (None, 1, "assistant", "last"), (None, 0, "user", None)]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
                                                  .withColumn("body", F.lit("clash")).withColumn("section", F.lit(1)).repartition(5)).collect()}
    assert len(got) == 4
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        told = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        learned = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_adjacent_turns_of_a_role_are_merged_across_sections(spark):
    rows = [(1, i, "user" if i < 300 else "assistant", f"t{i}") for i in range(520)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert f.formatted.count(chat.TURN) == 2 and f.formatted.count(chat.MORE) == 518 and f.formatted.count(chat.END) == 2
    assert [f.formatted[r.start: r.end] for r in f.loss] == [f"t{i}" for i in range(300, 520)]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- URL filter


def test_url_rules_and_list(spark):
    urls = {1: "HTTP://www.Example.ORG/es/a", 2: "https://example.org/en/12?x#y", 3: "https://sub.x.org/q", 4: "http://a.com/fr/1", 5: "http://a.com/de/1", 6: "http://notorg/", 7: "no scheme", 8: None, 9: "",
            10: "http://b.net/p/?utm_source=f", 11: "https://www.b.net:443/p.html#top", 12: "http://b.net/q", 13: "http://org", 14: "x://y://z.net/p", 15: "http://b.net/p?b=2&a=1&ref=z", 16: "http://b.net/p?a=1&b=2"}
    pages = spark.createDataFrame([(i, u, "h", "clash", 1) for i, u in urls.items()] + [(10, urls[10], "h", "clash", 1)], "page_id long, url string, html string, host string, block int")
    listed = spark.createDataFrame([("http://m.b.net/p/",), ("http://m.b.net/p/",), (None,), ("bad",), ("https://b.net/p?a=1&b=2",)], "url string")
    got = {r.page_id: r for r in url_filter.judged(pages, listed).collect()}
    assert url_filter.judged(pages, listed).count() == 17
    assert {i: r.rule for i, r in got.items() if r.rule} == {1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/fr/", 5: "com/de/"}
    assert {i for i, r in got.items() if r.listed} == {10, 11, 15, 16}
    assert (got[1].host, got[1].path, got[8].host, got[7].path, got[13].path, got[14].host) == ("www.example.org", "/es/a", "", "", "", "y:")
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 5, 10, 11, 15, 16}
    assert url_filter.judged(pages, listed.limit(0)).where("listed").count() == 0 and url_filter.judged(pages.limit(0), listed).count() == 0


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 2)
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.format_string("http://h.net/%d", "id").alias("url"))
    got = url_filter.judged(pages, pages.where("page_id % 3 = 0").select("url"))
    assert {r.page_id for r in got.where("listed").collect()} == set(range(0, 4000, 3))


# --- fixity


def test_audit_finds_exactly_the_bad_records(spark):
    rng = random.Random(6)
    first, second, want = [], [], set()
    for f in range(4):
        at = 0
        for _ in range(900):
            size, leaf = rng.randint(200, 90_000), hashlib.sha256(str(rng.random()).encode()).hexdigest()
            first.append((f, at, leaf))
            luck = rng.random() if f else 1.0
            if luck < 0.004:
                want.add((f, at, "missing"))
            elif luck < 0.008:
                want.add((f, at, "changed"))
                second.append((f, at, leaf[::-1]))
            else:
                second.append((f, at, leaf))
            at += size
        if f == 3:
            second.append((f, at, "0" * 64))
            want.add((f, at, "extra"))
    first += [(9, 0, "a" * 64), (9, 0, "b" * 64)]
    second += [(9, 0, "a" * 64), (9, 0, "c" * 64)]
    want.add((9, 0, "changed"))
    a, b = (spark.createDataFrame(x, "file long, offset long, leaf string").withColumn("place", F.lit(1)) for x in (first, second))
    roots, damage = fixity.audit(a, b)
    assert {(r.file, r.offset, r.state) for r in damage.collect()} == want
    assert {r.file for r in roots.where("first_root <=> second_root").collect()} == {0}
    assert fixity.audit(a, a)[1].count() == 0 and fixity.audit(a.limit(0), b.limit(0))[1].count() == 0
    assert {r.state for r in fixity.audit(a, b.limit(0))[1].collect()} == {"missing"}


def test_archive_of_pages(spark, monkeypatch):
    monkeypatch.setattr(fixity, "COPIES", 7)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (i % 50)) for i in range(3000)] + [(7, None, None), (None, "u", "x")] + [(5, "http://h/5", "é" * 5)] * 40, "page_id long, url string, html string")
    first, _ = fixity.archive_pair(pages)
    assert first.count() == pages.count() == 3042 and first.select("file", "offset").distinct().count() == 3042
    assert first.where("page_id = 5").count() == 41 and first.where("page_id = 5").select("file").distinct().count() > 5
    assert first.groupBy("file").count().agg(F.max("count")).first()[0] < 2 * fixity.FILE_RECORDS
    report = fixity.fixity_report(pages)
    bad = sum(r.n_bad for r in report.collect())
    assert sum(r.records for r in report.collect()) == 3042
    assert 10 < bad < 100 and report.where("first_root <=> second_root").where("n_bad > 0").count() == 0
    assert fixity.fixity_report(pages.limit(0)).count() == 0


# --- bin packing


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    for s in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and 0 <= s < binpack.SHARDS


def test_bin_packing(documents):
    rng = random.Random(8)
    texts = [sentence(rng.randint(1, 60), rng) for _ in range(4000)] + ["the same text"] * 2000 + [sentence(30, rng)] * 20 + [None, None, "", "é😀"]
    docs = documents(list(enumerate(texts)))
    rows = binpack.shard_report(docs).collect()
    check_shards(rows, texts)
    size, n, tokens = (np.zeros(24) for _ in range(3))
    shards_of = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == __import__("zlib").crc32(t.encode()) and r.grown_shard is None and r.law == "bytes"
        size[r.shard] += r.size
        n[r.shard] += 1
        tokens[r.shard] += r.tokens
        shards_of.setdefault(t, set()).add(r.shard)
    for x in (size, n, tokens):
        assert x.max() / x.mean() < 1.03 and x.min() / x.mean() > 0.97
    assert len(shards_of["the same text"]) > 8 and all(len(v) == 1 for t, v in shards_of.items() if t != "the same text")
    again = {(r.doc_id, r.shard, r.slot) for r in binpack.shard_report(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_bin_packing_small_tables(documents):
    assert binpack.shard_report(documents([])).count() == 0
    rows = binpack.shard_report(documents([(1, "a"), (1, "a"), (None, "b")])).collect()
    check_shards(rows, [0] * 3)


def test_slots_over_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(binpack, "BUCKET_ROWS", 5)
    texts = [sentence(5) for _ in range(600)]
    check_shards(binpack.shard_report(documents(list(enumerate(texts)))).collect(), texts)
