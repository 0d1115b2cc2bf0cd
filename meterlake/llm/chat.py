"""Chat formatting: a template with turn markers, and one example for each assistant turn.

Prefix-target expansion: the example of an assistant turn has all turns before it as context, and
only that reply is trained on. A conversation that does not end with a reply also has an example
of all its turns without a target, so that its last turns are kept.

Markers inside texts: every `<` that is followed by backslashes and a bar gets one backslash more,
so no text holds a marker, and one backslash less gives the text back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Also keeps a role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def training_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, text, loss_spans for (conv_id, turn, role, text).

    Turns are in order of turn, then role and text, so ties have one order; repeated rows are
    turns of their own. Null turns come first; null roles and texts are empty; a null conv_id is a
    conversation. loss_spans has the [start, end) code points of the trained reply in text, and is
    empty for an example without a target. Other columns are ignored."""
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.transform("turns", lambda t: F.struct(
        (t["role"] == TRAINED_ROLE).alias("reply"), F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")
    ))
    parts = whole.select("conv_id", formatted.alias("parts")).select(
        "conv_id", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))).alias("lines"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("parts", i - 1)["reply"] | (i == F.size("parts")))
    each = parts.select("conv_id", "parts", "lines", F.posexplode(targets).alias("example", "n_turns"))
    last = F.get("parts", F.col("n_turns") - 1)
    each = each.select(
        "conv_id", "example", "n_turns", last.alias("last"), F.array_join(F.slice("lines", 1, F.col("n_turns") - 1), "").alias("context"),
    ).withColumn("start", F.length("context") + F.length(F.col("last.head")))
    span = F.struct(F.col("start"), (F.col("start") + F.length("last.body")).alias("end"))
    return each.select(
        "conv_id", "example", "n_turns", F.concat("context", "last.head", "last.body", F.lit(END + "\n")).alias("text"),
        F.when(F.col("last.reply"), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("loss_spans"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) turns of an example's text."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, "\n")
        body = F.substr(piece, head + 1, F.length(piece) - head - len(END) - 1)
        return F.struct(unescaped_role(F.substr(piece, F.lit(1), head - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss_text(text: Column, spans: Column) -> Column:
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])), ""))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the
    examples. formatted_chars counts the code points of all examples of a conversation."""
    examples = training_examples(conversations)
    of_each = examples.select(
        "conv_id", "example", "n_turns", "text", F.length("text").alias("chars"), read_loss_text(F.col("text"), F.col("loss_spans")).alias("loss")
    )
    whole = of_each.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    ).withColumn("turns", read_turns(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
