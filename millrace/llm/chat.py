"""Chat formatting with Spark expressions only.

The template, for a conversation of turns::

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>
    <|im_start|>...

Adjacent turns of one role share a message; ``<|im_next|>`` stands between their texts, so that every
turn can be read back. Inside texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``; a line
feed in a role becomes ``&#10;``. No mark can then come from a text, and unescaping gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turns)``: the rows of a conversation in order of turn, then role, then text.

    A null text or role is empty, a null turn comes first, a repeated row is a turn of its own, rows with a
    null conversation form one conversation.
    """
    flat = narrow(rows, conv=conv, turn=turn, role=role, text=text).fillna("", ["role", "text"])
    return flat.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as messages ``(role, texts)``."""
    size = F.size(turns)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        places, lambda i: (i == 1) | (F.element_at(turns, i).role != F.element_at(turns, F.greatest(i - 1, F.lit(1))).role)
    )
    ends = F.concat(F.slice(starts, F.lit(2), size), F.array(size + 1))
    return F.zip_with(
        starts,
        F.slice(ends, F.lit(1), F.size(starts)),
        lambda a, b: F.struct(
            F.element_at(turns, a).role.alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t.text).alias("texts")
        ),
    )


def formatted(messages: Column) -> Column:
    """Messages by the template, as one string."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(START), escape_role(m.role), F.lit("\n"), F.array_join(F.transform(m.texts, escape), NEXT), F.lit(END)
            ),
        ),
        "",
    )


def literal(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_<\n" else c for c in mark)


def parsed(text: Column) -> Column:
    """The turns ``(role, text)`` read back from a formatted string."""
    blocks = F.filter(F.split(text, literal(START)), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        name = F.substring_index(block, "\n", 1)
        role = unescape_role(name)
        body = block.substr(F.length(name) + 2, F.length(block) - F.length(name) - 1 - len(END))
        return F.transform(F.split(body, literal(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``(<conv>, formatted)``. No rows in, no rows out."""
    grouped = conversations(rows, conv, turn, role, text)
    return grouped.select(F.col("conv").alias(conv), formatted(merged(F.col("turns"))).alias("formatted"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role and text) and ``loss_text`` (all text under the loss mask: that of
    the assistant), both read from ``formatted``."""
    read = chats.withColumn("turns", parsed(F.col("formatted")).cast(TURN))
    assistant = F.filter("turns", lambda t: t.role == "assistant")
    return read.withColumn("loss_text", F.array_join(F.transform(assistant, lambda t: t.text), ""))


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """Spans ``(start, end)`` of a formatted string that count for the loss: the texts of the role, in
    code points from 0, without the marks around and between them."""
    blocks = F.filter(F.split(text, literal(START)), lambda _, i: i > 0)
    at = F.struct(F.lit(0).cast("long").alias("place"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def message(state: Column, block: Column) -> Column:
        name = F.substring_index(block, "\n", 1)
        body = block.substr(F.length(name) + 2, F.length(block) - F.length(name) - 1 - len(END))
        first = state.place + len(START) + F.length(name) + 1
        parts = F.split(body, literal(NEXT))
        found = F.aggregate(
            parts,
            F.struct(first.alias("place"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
            lambda s, p: F.struct(
                (s.place + F.length(p) + len(NEXT)).alias("place"),
                F.concat(s.spans, F.array(F.struct(s.place.alias("start"), (s.place + F.length(p)).alias("end")))).alias("spans"),
            ),
        )
        spans = F.when(unescape_role(name) == role, found.spans).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
        return F.struct((state.place + len(START) + F.length(block)).alias("place"), F.concat(state.spans, spans).alias("spans"))

    return F.aggregate(blocks, at, message, lambda s: s.spans)
