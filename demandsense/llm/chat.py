"""Chat formatting in Spark expressions only: turns are sorted, adjacent turns of a role merged, and joined to one text.

Template: ``<|turn|>role<|text|>text<|end|>``; turns merged into one block are parted by ``<|more|>``.  Inside roles
and texts each control string (the template's and common ones of chat models) gets a tilde after its first
character, and one more if it has tildes there already, so no control string is left in a text and the change can
be undone.  The loss mask is the list of code point ranges of assistant texts.

A conversation is put together in two steps: sections of ``SECTION`` turn numbers are merged and joined first,
wherever they are, then the sections of a conversation.  Only its own text limits a conversation's size.

Defined results: turns are ordered by turn (null first), role and text, repeated rows are repeated turns; a null
role or text is empty; rows without a conversation id form one conversation; extra columns are ignored; an empty
table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.llm.spans import let, running_sum, sha256

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
# Control strings of common chat templates, escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>")
SECTION = 256
LEARNED_ROLE = "assistant"


def _tails() -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for x in (TURN, TEXT, MORE, END, *FOREIGN):
        by.setdefault(x[0], []).append(x[1:])
    return by


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in "|[]/<>()" else c for c in x)


def _pattern(inner: str) -> str:
    """One alternative for each first character: the character, ``inner``, and what the rest may be."""
    return "|".join(f"(?<={_quoted(head)}){inner}(?=~*(?:{'|'.join(map(_quoted, tails))}))" for head, tails in _tails().items())


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern("")), F.lit("~"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern("~")), F.lit(""))


def _merged(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role as one block."""
    none = F.slice(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))), 1, 0)

    def add(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        return F.when(last["role"] == t["role"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))))
    return F.aggregate(turns, none, add)


def _sections(rows: DataFrame) -> DataFrame:
    """conv_id, section, first and last role, body (without the first header and the last end mark)."""
    turn = F.struct(F.col("turn"), escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"), escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    got = rows.groupBy("conv_id", F.floor(F.col("turn") / SECTION).alias("section")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = got.select("conv_id", "section", _merged(F.col("turns")).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b, i: F.concat(
        F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(END + TURN), b["role"], F.lit(TEXT))), F.array_join(b["texts"], MORE))), "")
    return blocks.select("conv_id", "section", F.element_at("blocks", 1)["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"), body.alias("body"))


def loss_ranges(formatted: Column) -> Column:
    """array<struct<start, end>> of code points: every text of an assistant block, in order."""
    blocks = F.filter(F.split(formatted, _quoted(TURN)), lambda b: b != "")

    def pieces(b: Column) -> Column:
        """The texts of a block with the length of what stands before each (marks included)."""
        def cutup(parts: Column) -> Column:
            head, texts = F.element_at(parts, 1), F.split(F.regexp_replace(F.element_at(parts, 2), F.lit(_quoted(END) + "$"), F.lit("")), _quoted(MORE))
            return let(texts, lambda ts: F.transform(ts, lambda t, i: F.struct(
                (F.when(i == 0, F.length(head) + len(TURN) + len(TEXT)).otherwise(F.lit(len(MORE)))).alias("gap"), F.length(t).alias("size"),
                F.when(i == F.size(ts) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("tail"), (head == LEARNED_ROLE).alias("learned"))))
        return let(F.split(b, _quoted(TEXT)), cutup)

    def ranges(flat: Column) -> Column:
        ends = running_sum(F.transform(flat, lambda p: p["gap"] + p["size"] + p["tail"]))
        return let(ends, lambda e: F.transform(flat, lambda p, i: F.struct((F.get(e, i) - p["tail"] - p["size"]).alias("start"), (F.get(e, i) - p["tail"]).alias("end"), p["learned"].alias("learned"))))
    every = let(F.flatten(F.transform(blocks, pieces)), ranges)
    return F.transform(F.filter(every, lambda r: r["learned"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted (text), loss (array<struct<start, end>>, code points of ``formatted``)."""
    section = F.struct("section", "first", "last", "body")
    got = _sections(rows.select("conv_id", "turn", "role", "text")).groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))

    def joint(s: Column, i: Column) -> Column:
        before = F.get(F.col("sections"), i - 1)["last"]
        header = F.concat(F.lit(TURN), s["first"], F.lit(TEXT))
        return F.concat(F.when(i == 0, header).when(before == s["first"], F.lit(MORE)).otherwise(F.concat(F.lit(END), header)), s["body"])
    whole = got.select("conv_id", F.concat(F.array_join(F.transform("sections", joint), ""), F.lit(END)).alias("formatted"))
    return whole.select("conv_id", "formatted", loss_ranges(F.col("formatted")).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    def block(b: Column) -> Column:
        return let(F.split(b, _quoted(TEXT)), lambda p: F.transform(F.split(F.element_at(p, 2), _quoted(MORE)), lambda t: F.struct(
            unescaped(F.element_at(p, 1)).alias("role"), unescaped(t).alias("text"))))
    inner = F.regexp_replace(F.substring(formatted, len(TURN) + 1, 2 ** 31 - 1), F.lit(_quoted(END) + "$"), F.lit(""))
    return F.flatten(F.transform(F.split(inner, _quoted(END + TURN)), block))


def under(formatted: Column, ranges: Column) -> Column:
    """The text in ``ranges``, each range unescaped, joined; linear in the text, by way of a fixed-width encoding."""
    return let(F.encode(formatted, "UTF-32"), lambda w: F.array_join(F.transform(ranges, lambda r: unescaped(F.decode(F.substring(w, r["start"] * 4 + 1, (r["end"] - r["start"]) * 4), "UTF-32"))), ""))


def chat_report(rows: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted texts, one row per conversation."""
    done = format_conversations(rows)
    read = done.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), under(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(told).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       sha256(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def trial_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns say nothing but control strings."""
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED_ROLE).alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
