"""Chat formatting with a grammar round trip.

A conversation is rendered with a template that marks turns.  The rendered text is parsed
again with a deterministic grammar and the turns found are compared to the source; a turn
that does not come back identical is rendered again with its reserved strings escaped, and
the comparison is repeated.  ``round_trip`` reports the last comparison.

Grammar:  conversation = turn*;  turn = "<|turn|>" role "\\n" text "<|end|>\\n".
Role and text may hold no reserved string (RESERVED).  Escaping puts one more backslash
behind the first character of every reserved string, counting backslashes already there,
and parsing takes one away, so escaping is reversible on every input.  In a role,
backslash and line feed become ``\\b`` and ``\\n`` as well.

Defined results: a null text or role is empty; turns sort by turn (nulls first), then
role, then text, repeated rows stay; rows without a conv_id form one conversation; an
empty table gives no rows.  A conversation is one output row, so its own text is gathered
in one task; conversations are never gathered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
# Strings that mark structure in this template or in other common ones.
RESERVED = r"<\||</?s>|<</?SYS>>|\[/?INST\]"
_AHEAD = [("<", r"(?=\||/?s>|</?SYS>>)", "<"), (r"\[", r"(?=/?INST\])", "[")]


def escape(text: Column) -> Column:
    for first, ahead, plain in _AHEAD:
        text = F.regexp_replace(text, rf"{first}(\\*+){ahead}", rf"{plain}\\$1")
    return text


def unescape(text: Column) -> Column:
    for first, ahead, plain in _AHEAD:
        text = F.regexp_replace(text, rf"{first}\\(\\*+){ahead}", rf"{plain}$1")
    return text


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation; a stretch that breaks the grammar gives nulls."""
    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        role = F.substring_index(body, "\n", 1)
        good = F.startswith(part, F.lit(OPEN)) & F.contains(body, F.lit("\n")) & ~body.rlike(RESERVED)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(F.when(good, unescape_role(role)).alias("role"), F.when(good, unescape(text)).alias("text"))

    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def _render(t: Column, escaped: Column) -> Column:
    role = F.when(escaped, escape_role(t["role"])).otherwise(t["role"])
    text = F.when(escaped, escape(t["text"])).otherwise(t["text"])
    return F.struct(F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"),
                    (t["role"] == LOSS_ROLE).alias("loss"))


def _text(pieces: str) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, round_trip), one row per conversation.

    ``rows`` needs conv_id, turn, role, text.  ``loss_spans`` are code-point ranges
    (start, end) of ``formatted``, one per assistant turn.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    conv = conv.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # Round 1: as it is, each turn on its own; round 2: the turns that did not come back.
    same = F.transform("turns", lambda t: F.coalesce(
        parse(F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))) == F.array(t), F.lit(False)))
    conv = conv.select("conv_id", "turns", same.alias("plain"))
    conv = conv.select("conv_id", "turns", F.zip_with("turns", "plain", lambda t, ok: _render(t, ~ok)).alias("pieces"))
    conv = conv.select("conv_id", "turns", "pieces", _text("pieces").alias("formatted"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        out = F.when(p["loss"], F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
                     ).otherwise(acc["out"])
        return F.struct((end + len(CLOSE)).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted",
                       F.aggregate("pieces", zero, step, lambda a: a["out"]).alias("loss_spans"),
                       F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False)).alias("round_trip"))


def digest(formatted: DataFrame) -> DataFrame:
    """The result columns of query op10, read back from the rendered text and the mask alone."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    d = formatted.select("conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), "formatted",
                         "round_trip", turns.alias("turns"), loss.alias("loss"))
    return d.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
