"""Quality rules: an ordered decision list learned from labelled statistics.

``with_text_stats`` counts over the whole text in Arrow batches.  ``learn`` runs sequential covering on the
statistics of labelled rows: a rule is grown by adding the threshold condition with the best information gain
on two thirds of the rows, pruned back on the other third, and the rows it covers are set aside before the next
rule is grown.  ``RuleList.reason`` writes the list as one ordered Spark ``CASE WHEN``.

Defined results: a null or empty text has no words and fails the base rule; a row without statistics of a rule
(a ratio over nothing) has 0 there; without labels, or with one class only, no rule is learned and the base rule
decides alone; repeated rows and ties get the same verdict; extra columns are kept, those with the names of
result columns are replaced.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.llm.shipping import by_value

by_value(__name__)

# The base rule and the symbols it counts.
SYMBOLS, WINDOW, MIN_WORDS, REPEAT_PERCENT = b"#*$%&|<>", 8, 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ended", "n_distinct")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

#: At most so many labelled rows are fitted on, the lowest by a hash of their id.
FIT_ROWS = 20_000
#: A rule must reject at least this share of bad rows among those it covers, on rows held out from growing.
MIN_PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_SPACE_NOT_CONTINUED = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    # ranks of windows of 2, 4 and 8 words, from pairs of ranks: equal ranks mean equal words
    for width in (1, 2, 4):
        pair = (code[:-width] << np.uint64(32)) | code[width:]
        _, code = np.unique(pair, return_inverse=True)
        code = code.astype(np.uint64)
    counts = np.bincount(code.astype(np.int64))
    starts = np.flatnonzero(counts[code.astype(np.int64)] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(_NOT_SPACE_NOT_CONTINUED[raw].sum()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), int(_UPPER[raw].sum()), int(_DIGIT[raw].sum()), sum(w[-1] in b".!?" for w in words), len(set(words)))


def _stats(text: pa.Array) -> pa.Array:
    rows = [text_stats(t.as_py() or b"") for t in text.cast(pa.binary())]  # one text at a time
    columns = zip(*rows) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def with_text_stats(docs: DataFrame, name: str = "stats") -> DataFrame:
    """``docs`` and a struct column with the counts of the whole text."""
    return docs.withColumn(name, F.arrow_udf(_stats, STATS_TYPE)(F.col("text")))


def features(s: Column) -> dict[str, Column]:
    """What conditions are made of; ratios over nothing are 0."""
    def share(a: str, b: str) -> Column:
        return F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {"words": s["n_words"].cast("double"), "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"),
            "digit_share": share("n_digits", "word_chars"), "ended_share": share("n_ended", "n_words"), "distinct_share": share("n_distinct", "n_words"),
            "words_a_line": share("n_words", "n_lines")}


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.cut if self.above else x <= self.cut

    def column(self, by: dict[str, Column]) -> Column:
        x = by[self.feature]
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


class RuleList(NamedTuple):
    rules: tuple[tuple[Condition, ...], ...]

    def reason(self, by: dict[str, Column]) -> Column:
        """The first rule that holds, as text; null if none does."""
        out: Column | None = None
        for rule in self.rules:
            holds = rule[0].column(by)
            for c in rule[1:]:
                holds = holds & c.column(by)
            text = F.lit(" and ".join(map(str, rule)))
            out = F.when(holds, text) if out is None else out.when(holds, text)
        return F.lit(None).cast("string") if out is None else out


def _covered(rule: Sequence[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    on = np.ones(n, bool)
    for c in rule:
        on &= c.mask(table)
    return on


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and bad[on].any() and not bad[on].all():
        p0, n0 = bad[on].sum(), on.sum()
        base, best = np.log2(p0 / n0), (1e-9, None)
        for name, x in table.items():
            values = np.unique(x[on])
            if len(values) < 2:
                continue
            mids = (values[1:] + values[:-1]) / 2
            if len(mids) > CUTS:  # fewer, with a grid of its own for the bad rows; each stays midway between two values
                grid = np.concatenate([np.quantile(x[on], np.linspace(0, 1, CUTS)), np.quantile(x[on & bad], np.linspace(0, 1, CUTS))])
                at = np.searchsorted(values, grid)
                mids = np.unique(mids[np.clip(np.concatenate([at - 1, at]), 0, len(mids) - 1)])
            order = np.argsort(x[on], kind="stable")
            xs, cum = x[on][order], np.concatenate([[0], np.cumsum(bad[on][order])])
            at = np.searchsorted(xs, mids, side="right")
            for above in (False, True):
                n = (n0 - at) if above else at
                p = (p0 - cum[at]) if above else cum[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((p > 0) & (n < n0), p * (np.log2(p / np.maximum(n, 1)) - base), -1.0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(mids[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].mask(table)
    return rule


def _pruned(rule: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], float, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on the held-out rows."""
    best: tuple[float, int, float, int] = (-2.0, 0, 0.0, 0)
    for k in range(1, len(rule) + 1):
        on = _covered(rule[:k], table, len(bad))
        p, n = int(bad[on].sum()), int((~bad[on]).sum())
        if p + n and (score := (p - n) / (p + n)) > best[0]:
            best = (score, k, p / (p + n), p)
    return rule[: best[1]], best[2], best[3]


def cover(table: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> RuleList:
    """Sequential covering: rules are added until one fails on the held-out rows or no bad row is left."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and bad[left].any():
        grow, prune = left & ~held, left & held
        rule = _grow({k: x[grow] for k, x in table.items()}, bad[grow])
        rule, precision, hits = _pruned(rule, {k: x[prune] for k, x in table.items()}, bad[prune])
        if not rule or precision < MIN_PRECISION or hits < 2:
            break
        rules.append(tuple(rule))
        left &= ~_covered(rule, table, len(bad))
    return RuleList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleList:
    """The decision list for ``quality = 0`` from at most ``rows`` labelled documents, chosen by a hash of the id."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = with_text_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    known = known.groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))
    by = features(F.col("stats"))
    got = known.select("doc_id", "label", *[c.alias(k) for k, c in by.items()]).toPandas().sort_values("doc_id")
    if got["label"].nunique() < 2:
        return RuleList(())
    held = np.array([xxhash.xxh64_intdigest(str(i), 7) % 3 == 0 for i in got["doc_id"]])
    return cover({k: got[k].to_numpy(float) for k in by}, (got["label"] == 0).to_numpy(), held)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def judged(docs: DataFrame, rules: RuleList) -> DataFrame:
    """``docs`` with struct ``stats``, boolean ``base_failed``, string ``reason`` (the learned rule that holds, or null) and boolean ``kept``."""
    out = with_text_stats(docs)
    s = F.col("stats")
    return (out.withColumn("base_failed", base_failed(s)).withColumn("reason", rules.reason(features(s)))
            .withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull()))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts and the verdict of each document."""
    out = judged(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", *[F.col("stats")[c].alias(c) for c in COUNTS[:5]], "base_failed", "kept", "reason")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    packed = docs.select("text", F.struct("*").alias("row"))
    return judged(packed, learn(docs, labels)).where("kept").select("row.*")
