"""Secret scan in Spark expressions only: fixed key formats plus strings of high local entropy.

Candidate strings are maximal runs of one character class.  A window slides over a run; the counts of the
characters in it, and the sum of ``c * log2(c)`` over them, are kept up to date as one character enters and one
leaves, so each step costs the same whatever the window.  Windows at or over the class's entropy mark the part
of the run that is reported, unless the whole run is on the allow-list or a fixed-format match covers it.  Placeholders
and repeated characters inside a run are masked: they cut it, and the parts between them are judged each on its own.

Defined results: a null or empty text has no spans; repeated rows are judged each on its own; extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.llm.spans import in_order, let, running_sum, sha256, spans, written

# The formats of the three base kinds. Possessive or bounded forms match what the plain ones match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGNED_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")


class CharClass(NamedTuple):
    kind: str
    alphabet: str
    case_folded: bool
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (CharClass("entropy_hex", _DIGITS + "abcdef", True, 20, 3.0),
           CharClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", False, 24, 4.0))
# Whole runs that are known not to be secrets: plain words, joined words, numbers, UUIDs. A repeated group is possessive: it does not recurse.
ALLOWED = (r"[A-Za-z]?[a-z]++", r"[A-Z]++", r"[0-9]++", r"(?:[A-Za-z]++[/_-]++)++[A-Za-z]*+", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# Parts of runs that are not: repeated characters, placeholders. They cut a run; what is left on either side is judged.
MASKED = (r"(.)\1{7,}+", r"(?i:example|sample|placeholder|changeme|your[_-]|0123456789|abcdefgh)")


def _run_pattern(c: CharClass) -> str:
    chars = "".join("\\" + x if x in "-/+=" else x for x in c.alphabet)
    chars += "A-F" if c.case_folded else ""
    return f"(?<![{chars}])[{chars}]{{{c.window},}}+"


def entropy_hull(value: Column, c: CharClass) -> Column:
    """struct<lo, hi, bits>: the hull of all windows at or over the threshold (lo -1: none) and the highest entropy.

    ``value`` holds characters of the class only, at least a window of them.
    """
    w = c.window
    clog = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(w + 2)])
    codes = F.transform(F.filter(F.split(F.lower(value) if c.case_folded else value, ""), lambda x: x != ""), lambda x: F.instr(F.lit(c.alphabet), x) - 1)
    zeros = F.array_repeat(F.lit(0), len(c.alphabet))
    start = F.struct(zeros.alias("count"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0.0).alias("bits"))

    def run(code: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(code, i), F.when(i >= w, F.get(code, i - w)).otherwise(F.lit(-1))
            gone = F.when(leaves >= 0, F.get(acc["count"], leaves)).otherwise(F.lit(0))
            had = F.get(acc["count"], enters) - F.when(enters == leaves, 1).otherwise(0)
            total = acc["sum"] + F.when(leaves >= 0, F.get(clog, gone - 1) - F.get(clog, gone)).otherwise(0.0) + F.get(clog, had + 1) - F.get(clog, had)
            count = F.transform(acc["count"], lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))

            def state(t: Column) -> Column:
                def judged(bits: Column) -> Column:
                    over = (i >= w - 1) & (bits >= c.bits)
                    return F.struct(count.alias("count"), t.alias("sum"), F.when(over & (acc["lo"] < 0), i - (w - 1)).otherwise(acc["lo"]).alias("lo"),
                                    F.when(over, i + 1).otherwise(acc["hi"]).alias("hi"),
                                    F.when(i >= w - 1, F.greatest(acc["bits"], bits)).otherwise(acc["bits"]).alias("bits"))
                return let(math.log2(w) - t / w, judged)
            return let(total, state)
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda a: F.struct(a["lo"], a["hi"], a["bits"]))
    return let(codes, run)


def base_spans(text: Column) -> Column:
    assign = F.filter(spans(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGNED_LEAST)
    return in_order([assign, spans(text, ACCESS, "access", 1), spans(text, HEX, "hex", 2)])


def unmasked(run: Column, masked: str, least: int) -> Column:
    """The parts of a span that ``masked`` does not match, of ``least`` characters or more, as spans."""
    def build(m: Column, gap: Column) -> Column:
        ends = running_sum(F.transform(gap, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(m, i)), F.lit(0))))
        parts = let(ends, lambda e: F.transform(gap, lambda g, i: let(
            run["start"] + F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)), lambda at: F.struct(
                at.alias("start"), run["rank"].alias("rank"), (at + F.length(g)).alias("end"), run["kind"].alias("kind"), g.alias("value"), run["before"].alias("before"), run["after"].alias("after")))))
        return F.filter(parts, lambda p: F.length(p["value"]) >= least)
    cut = let(F.struct(F.regexp_extract_all(run["value"], F.lit(masked), F.lit(0)).alias("m"), F.split(run["value"], masked, -1).alias("gap")), lambda c: build(c["m"], c["gap"]))
    return F.when(F.regexp_like(run["value"], F.lit(masked)), cut).otherwise(F.array(run))


def entropy_spans(text: Column, base: Column, classes: Sequence[CharClass], allowed: Sequence[str], masked: Sequence[str]) -> Column:
    allow, mask = "|".join(f"^(?:{p})$" for p in allowed) or r"\b\B", "|".join(masked) or r"\b\B"

    def of_class(k: int, c: CharClass) -> Column:
        def worth(s: Column) -> Column:
            ok = ~F.regexp_like(s["value"], F.lit(allow))
            for earlier in classes[:k]:  # a run of a narrower class was judged there
                ok = ok & ~F.regexp_like(s["value"], F.lit("^" + _run_pattern(earlier).split(")", 1)[1] + "$"))
            return ok

        def hull(s: Column) -> Column:
            return let(entropy_hull(s["value"], c), lambda h: F.struct(
                (s["start"] + h["lo"]).alias("start"), s["rank"].alias("rank"), (s["start"] + h["hi"]).alias("end"), s["kind"].alias("kind"),
                F.when(h["lo"] >= 0, s["value"]).alias("value"), s["before"].alias("before"), s["after"].alias("after")))
        runs = F.filter(spans(text, _run_pattern(c), c.kind, len(BASE_KINDS) + k), worth)
        parts = F.filter(F.flatten(F.transform(runs, lambda s: unmasked(s, mask, c.window))), lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
        return F.filter(F.transform(parts, hull), lambda s: s["value"].isNotNull())

    return in_order([of_class(k, c) for k, c in enumerate(classes)])


def scan_secrets(docs: DataFrame, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, masked: Sequence[str] = MASKED) -> DataFrame:
    """doc_id, base (array of fixed-format spans), added (array of entropy spans); one row per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return rows.select("doc_id", "base", entropy_spans(F.col("text"), F.col("base"), classes, allowed, masked).alias("added"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The counts and digests of the scan, one row per document."""
    found = scan_secrets(docs)

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], sha256(written(F.col("base"))).alias("base_sha256"),
                        written(in_order([F.col("base"), F.col("added")])).alias("spans"), F.size("added").cast("long").alias("n_entropy"))
