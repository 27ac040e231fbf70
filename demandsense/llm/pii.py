"""Personal data by weak supervision, in Spark expressions only.

Candidate spans come from strict patterns (the base, always reported) and from loose ones.  Five labelers vote +1, 0
or -1 on each: format, structure, gazetteer, context words and neighbouring characters.  Votes are counted by pattern over all
documents (at most 3 ** 5 patterns for a kind and shape), expectation-maximisation over those counts estimates how
reliable each labeler is for each kind, and the posteriors train a logistic span classifier, which decides on the loose
candidates.  The classifier's few numbers become constants of one Spark expression.

Defined results: a null or empty text has no spans; equal rows get equal spans; without any candidate there is no
classifier and nothing is added; a loose candidate that touches a base span is dropped; extra columns are ignored by
``personal_data`` and kept by ``redacted``, where a null text stays null.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.llm.spans import let, replaced, sha256, spans, written

BASE_KINDS = ("email", "ip", "card", "phone")
AROUND = 40
ROUNDS = 25
#: Weight of the starting reliabilities (0.8 right) against the counts.
BELIEF, TRUST = 20.0, 0.8
LABELERS = ("format", "structure", "gazetteer", "context", "neighbours")
SHAPES = 4

# Small gazetteers and cue words.
DOMAIN_ENDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|at|ch|it|nl|eu|mx|ar"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
UNROUTED = r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."
GIVEN_NAMES = "Anna|Maria|María|Peter|Paul|John|Jean|José|Juan|Carlos|Hans|Klaus|Marie|Pierre|Luis|Laura|Sarah|David|Thomas|Michael"
FOR_IT = r"(?i)(?:mail|contact|call|phone|tel|fax|mobil|card|visa|konto|account|iban|ssn|address|adresse|dirección|host|server|dear|liebe|estimad|signed|ask for|\bip\b)"
AGAINST_IT = r"(?i)(?:version|isbn|chapter|section|figure|page|order no|seite|kapitel|§)"


class Source(NamedTuple):
    """A pattern for candidates of a kind and, for base kinds, what a match must satisfy."""
    kind: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    strict: bool = True
    #: A text without any of these has no match and is not searched.
    needs: tuple[str, ...] = ()


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = 2 * d
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


_LOCAL = "A-Za-z0-9._%+-"
# The base patterns start where a run starts or the last match ended, and repeat possessively: the same matches in linear time.
SOURCES = (
    Source("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs=("@",)),
    Source("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets),
    Source("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", lambda v: luhn(_digits(v))),
    Source("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), needs=("+",)),
    Source("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}", None, False, ("(at)", "[at]")),
    Source("phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", None, False),
    Source("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, False),
    Source("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, False),
    Source("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señor|Señora)\.?\x20\p{Lu}[\p{L}'-]{1,40}(?:\x20\p{Lu}[\p{L}'-]{1,40})?", None, False),
)
KINDS = tuple(dict.fromkeys(s.kind for s in SOURCES))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(s: Column, source: Source) -> Column:
    v, no, yes = s["value"], F.lit(False), F.lit(True)
    digits = _digits(v)
    like = lambda p: F.regexp_like(v, F.lit(p))
    structure = {"email": _vote(like(r"[.)\]]\x20?[A-Za-z]{2,}$"), yes), "ip": _vote(~like(r"(?:^|\.)0[0-9]"), yes), "card": _vote(F.length(digits).isin(15, 16), yes),
                 "phone": _vote(like(r"[0-9][\x20().-]+[0-9]"), no), "iban": _vote(like("[0-9]{6}"), like(r"^[A-Z0-9]{4}(?:\x20[A-Z]{4}){3}")),
                 "id": _vote(~like("^(?:000|666|9)|-00-|-0000$"), yes), "name": _vote(like(r"\p{Ll}{2}$"), no)}
    gazetteer = {"email": _vote(like(rf"(?i)[.)\]]\x20?(?:{DOMAIN_ENDS})$"), no), "ip": _vote(~like(UNROUTED), yes), "card": _vote(F.regexp_like(digits, F.lit(CARD_STARTS)), yes),
                 "phone": _vote(like(CALLING_CODES), no), "iban": _vote(like("^(?:DE|FR|ES|AT|CH|IT|NL|GB|BE|PT)"), no), "id": F.lit(0), "name": _vote(like(rf"\b(?:{GIVEN_NAMES})\b"), no)}
    context = _vote(F.regexp_like(s["before"], F.lit(FOR_IT)), F.regexp_like(s["before"], F.lit(AGAINST_IT)))
    beside = _vote(F.regexp_like(s["before"], F.lit(r"(?:^|[\s(:,;<\"'])$")) & F.regexp_like(s["after"], F.lit(r"^(?:$|[\s).,:;>\"'!?])")), F.regexp_like(s["before"], F.lit(r"[\p{L}0-9/=#]$")))
    return F.array(F.lit(1 if source.strict else -1), structure[source.kind], gazetteer[source.kind], context, beside)


def candidates(text: Column) -> Column:
    """array<struct<start, rank, end, kind, base, votes, shape>> in order; base spans and loose candidates clear of them."""
    def of(rank: int, source: Source) -> Column:
        searched = F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in source.needs]), text).otherwise(F.lit("")) if source.needs else text
        got = spans(searched, source.pattern, source.kind, rank, AROUND)
        if source.valid is not None:
            got = F.filter(got, lambda s: source.valid(s["value"]))
        return F.transform(got, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(source.strict).alias("base"),
                                                   _votes(s, source).alias("votes"), F.least(F.floor((s["end"] - s["start"]) / 8).cast("int"), F.lit(SHAPES - 1)).alias("shape")))
    base = [of(k, s) for k, s in enumerate(SOURCES) if s.strict]
    loose = [of(k, s) for k, s in enumerate(SOURCES) if not s.strict]

    def both(b: Column) -> Column:
        clear = F.filter(F.concat(*loose), lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"])))
        return F.array_sort(F.concat(b, clear))
    return let(F.concat(*base), both)


def _posterior(pats: Column, st: Column) -> Column:
    """array<struct<n, votes, q>>: probability that spans with this vote pattern are personal data."""
    def odds(votes: Column) -> Column:
        def add(total: Column, j: Column) -> Column:
            v, a, b = F.get(votes, j), F.get(st["hit"], j), F.get(st["miss"], j)
            return total + F.when(v == 1, F.ln(a / b)).when(v == -1, F.ln((1 - a) / (1 - b))).otherwise(0.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), F.ln(st["prior"] / (1 - st["prior"])), add)
    return F.transform(pats, lambda p: F.struct(p["n"].alias("n"), p["votes"].alias("votes"), (1 / (1 + F.exp(-odds(p["votes"])))).alias("q")))


def _reestimated(post: Column) -> Column:
    def total(weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(post, F.lit(0.0), lambda s, p: s + weight(p))

    def rate(true: bool, start: float) -> Column:
        def share(p: Column) -> Column:
            return p["n"] * (p["q"] if true else 1 - p["q"])
        return F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), lambda j: (
            total(lambda p: F.when(F.get(p["votes"], j) == 1, share(p)).otherwise(0.0)) + BELIEF * start)
            / (total(lambda p: F.when(F.get(p["votes"], j) != 0, share(p)).otherwise(0.0)) + BELIEF))
    prior = (total(lambda p: p["n"] * p["q"]) + BELIEF / 2) / (total(lambda p: p["n"]) + BELIEF)
    return F.struct(prior.alias("prior"), rate(True, TRUST).alias("hit"), rate(False, 1 - TRUST).alias("miss"))


def reliabilities(counts: DataFrame) -> DataFrame:
    """kind, prior, hit, miss from columns kind, votes, n (double): expectation-maximisation, one row for each kind."""
    k = len(LABELERS)
    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(TRUST), k).alias("hit"), F.array_repeat(F.lit(1 - TRUST), k).alias("miss"))
    pats = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("n", "votes"))).alias("pats"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda st, _: let(_posterior(F.col("pats"), st), _reestimated))
    return pats.select("kind", state.alias("st")).select("kind", "st.*")


def _features(kind: Column, votes: Column, shape: Column) -> list[Column]:
    return ([F.when(kind == k, 1.0).otherwise(0.0) for k in KINDS] + [F.when(F.get(votes, F.lit(j)) == v, 1.0).otherwise(0.0) for j in range(len(LABELERS)) for v in (1, -1)]
            + [F.when(shape == k, 1.0).otherwise(0.0) for k in range(SHAPES)])


class SpanClassifier(NamedTuple):
    weights: tuple[float, ...]
    bias: float

    def accepts(self, s: Column) -> Column:
        score = F.lit(self.bias)
        for w, x in zip(self.weights, _features(s["kind"], s["votes"], s["shape"])):
            score = score + F.lit(w) * x
        return score >= 0


def train(found: DataFrame) -> SpanClassifier | None:
    """The classifier from column ``found`` of candidate spans; None without any."""
    seen = found.select(F.explode("found").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.shape").alias("shape")).agg(F.count("*").cast("double").alias("n"))
    seen = cut(seen)
    if seen.isEmpty():
        return None
    model = F.broadcast(reliabilities(seen))  # one row for each kind
    known = seen.join(model, "kind")
    q = F.element_at(_posterior(F.array(F.struct("n", "votes")), F.struct("prior", "hit", "miss")), 1)["q"]
    soft = known.select(array_to_vector(F.array(*_features(F.col("kind"), F.col("votes"), F.col("shape")))).alias("features"), "n", q.alias("q"))
    rows = soft.select("features", F.lit(1.0).alias("label"), (F.col("n") * F.col("q") + 1e-6).alias("weight")).unionByName(
        soft.select("features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("q")) + 1e-6).alias("weight")))
    fitted = LogisticRegression(weightCol="weight", maxIter=20, regParam=1e-4, standardization=False).fit(rows.coalesce(1))
    return SpanClassifier(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def chosen(found: Column, model: SpanClassifier | None) -> Column:
    """Base spans and the accepted loose ones."""
    return F.filter(found, lambda s: s["base"] | model.accepts(s)) if model else F.filter(found, lambda s: s["base"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of base and accepted spans)."""
    found = cut(docs.select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")))
    return found.select("doc_id", chosen(F.col("found"), train(found)).alias("spans"))


def personal_report(docs: DataFrame) -> DataFrame:
    """The counts and digests, one row per document."""
    got = personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    return got.select("doc_id", *[F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                      sha256(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew."""
    text = F.coalesce(F.col("text"), F.lit(""))
    model = train(cut(docs.select(candidates(text).alias("found"))))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), candidates(text).alias("found"))
    clean = packed.select("row", replaced(F.col("text"), chosen(F.col("found"), model), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
