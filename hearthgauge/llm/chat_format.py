"""Conversations as one text each, checked by reading it back. DataFrame functions only.

The grammar of a text:

    text  := level turn*
    level := "0" | "1"
    turn  := "<s>[INST] " plain " [/INST]" plain "</s>"
    plain := any string without "<s>", "</s>", "[INST]" and "[/INST]"

Level 0 has roles and texts as they are. Where the parser, which takes nothing but this grammar, does not give the
source's turns, level 1 is used: the control strings and the backslash in roles and texts are written as a backslash
and a letter, so no control string is left in them and reading gives the turns back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import let, running_sums

#: What is escaped, in this order, and read back in the reverse order.
ESCAPES = (("\\", "\\e"), ("</s>", "\\c"), ("<s>", "\\o"), ("[INST]", "\\i"), ("[/INST]", "\\j"))
CONTROLS = tuple(e[0] for e in ESCAPES[1:])
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def read(text: Column, level: Column) -> Column:
    return F.when(level == "1", unescape(text)).otherwise(text)


def render(turns: Column, level: int) -> Column:
    """Turns (array of role, text) as one text."""
    as_is = (lambda c: c) if level == 0 else escape
    return F.concat(F.lit(str(level)), F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), as_is(t["role"]), F.lit(MIDDLE), as_is(t["text"]), F.lit(CLOSE))), ""))


def parse(text: Column) -> Column:
    """(turns, mask) of a text of the grammar; null of any other text. turns: array of role, text; mask: array of start
    and end, in code points, of the texts of LEARNT turns."""

    def cut(part: Column) -> Column:
        """Role and text of a turn as written; null unless it opens and parts as a turn does and both are plain."""
        at = F.instr(part, MIDDLE)
        pieces = F.struct(F.substr(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1).alias("role"), F.substr(part, at + len(MIDDLE)).alias("text"))
        plain = lambda c: reduce(lambda a, b: a & b, [~F.contains(c, F.lit(x)) for x in CONTROLS])
        fine = let(pieces, lambda p: F.when(plain(p["role"]) & plain(p["text"]), p))
        return F.when(F.startswith(part, F.lit(OPEN)) & (at > len(OPEN)), fine)

    def of(x: Column) -> Column:
        size = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)
        turns = F.transform(x["cuts"], lambda t: F.struct(read(t["role"], x["level"]).alias("role"), read(t["text"], x["level"]).alias("text")))
        begins = running_sums(F.transform(x["cuts"], size))

        def masked(begin: Column) -> Column:
            spans = F.transform(x["cuts"], lambda t, i: F.struct(read(t["role"], x["level"]).alias("role"), (begin[i] + 1 + len(OPEN) + F.length(t["role"]) + len(MIDDLE)).alias("start"), F.length(t["text"]).alias("n")))
            return F.transform(F.filter(spans, lambda s: s["role"] == LEARNT), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")))

        fine = x["level"].isin("0", "1") & (x["last"] == "") & ~F.exists(x["cuts"], lambda t: t.isNull())
        return F.when(fine, F.struct(turns.alias("turns"), let(begins, masked).alias("mask")))

    def parts(x: Column) -> Column:
        body = F.slice(x["parts"], 1, F.size(x["parts"]) - 1)
        return F.struct(x["level"].alias("level"), F.transform(body, cut).alias("cuts"), F.element_at(x["parts"], -1).alias("last"))

    split = F.struct(F.left(text, F.lit(1)).alias("level"), F.split(F.substr(text, F.lit(2)), CLOSE).alias("parts"))
    return let(let(split, parts), of)


def under_mask(formatted: Column, mask: Column) -> Column:
    """What the mask covers, read as the level says, in order, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: read(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), F.left(formatted, F.lit(1)))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of `turns` (conv_id, turn, role, text): conv_id, formatted, parsed (array of role, text as read
    back), mask (array of start, end in `formatted`, code points, of the texts of LEARNT turns).

    Turns are ordered by turn, then role and text, so rows in any order give one result; repeated rows are repeated
    turns. Null roles and texts count as empty, a null turn comes first, rows without conv_id make one conversation.
    A conversation is one row, so its turns meet in one task; that is the result asked for. Other columns are ignored.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    source = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), 0))
    same = F.coalesce(parse(F.col("plain"))["turns"] == F.col("source"), F.lit(False))
    formatted = plain.withColumn("formatted", F.when(same, F.col("plain")).otherwise(render(F.col("source"), 1)))
    checked = formatted.withColumn("back", parse(F.col("formatted")))
    sure = F.when(F.coalesce(F.col("back.turns") == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    return checked.select("conv_id", sure.alias("formatted"), F.col("back.turns").alias("parsed"), F.col("back.mask").alias("mask"))
