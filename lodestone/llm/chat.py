"""Chat formatting with typed content parts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: One content part. text for "text"; ref names an attachment; the sizes expand its tokens.
PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
#: Tokens that a placeholder stands for: image tiles of 28 x 28, audio frames of 40 ms, pages.
TILE, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256
KINDS = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Puts one more backslash between ``<`` and ``|``: no control string is left, and it can be undone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: backslash and line feed are spelt out before the control strings."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def expanded(part: Column) -> Column:
    """Tokens that an attachment takes once expanded; unknown sizes count as the least unit."""
    tiles = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(1)) / TILE), F.lit(1))
    return (
        F.when(part["type"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND), F.lit(1)))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Flattens parts, in order, to (text with placeholders, attachment references, expanded tokens).

    Text is escaped; an attachment becomes ``<|image|>``, ``<|audio|>`` or ``<|document|>``,
    which no text can spell. A part of another or no type counts as text. A null array has
    no parts; a null part adds nothing.
    """
    is_attachment = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))
    known = F.filter(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())
    text = F.array_join(F.transform(known, lambda p: F.when(is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(p["text"]))), "")
    attached = F.filter(known, is_attachment)
    refs = F.transform(attached, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    tokens = F.aggregate(attached, F.lit(0).cast("long"), lambda a, p: a + expanded(p))
    return text, refs, tokens


def text_parts(text: Column) -> Column:
    """A plain message as a single text part."""
    null = lambda name: F.lit(None).cast(PART[name].dataType).alias(name)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(null(f.name) for f in PART.fields[2:])))


def format_chats(messages: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", per_block: int = 64) -> DataFrame:
    """One row per conversation: conv id, ``blocks``, ``attachments``, ``expanded_tokens``.

    A turn is ``<|im_start|>role``, a line feed, its flattened parts, ``<|im_end|>`` and a line
    feed. Turns stand in the order of (turn, role, text), nulls first. Rows are first joined
    to blocks of ``per_block`` turn numbers and the blocks then to conversations, so a
    conversation with a third of all rows reaches its last task as a few long strings. A
    block has its text and the spans (start, length in characters of the block) that carry
    loss: what assistants say, and nothing of the template. Null conversation ids make one
    conversation; repeated rows are turns of their own; no rows, no conversation.
    """
    body, refs, tokens = visit(parts)
    head = F.concat(F.lit(START), escape_role(F.col(role)), F.lit("\n"))
    turns = messages.select(
        F.col(conv).alias("c"),
        F.floor(F.col(turn) / per_block).alias("b"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), body.alias("body"), head.alias("head"), refs.alias("refs"), tokens.alias("tokens")).alias("m"),
    )
    ordered = turns.groupBy("c", "b").agg(F.array_sort(F.collect_list("m"), _before).alias("ms"))
    whole = lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "ms",
        zero,
        lambda a, m: F.struct(
            (a["at"] + F.length(whole(m))).alias("at"),
            F.when(m["r"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(m["head"])).alias("start"), F.length(m["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    block = ordered.select(
        "c",
        F.struct(
            "b",
            F.array_join(F.transform("ms", whole), "").alias("text"),
            spans.alias("spans"),
            F.flatten(F.transform("ms", lambda m: m["refs"])).alias("refs"),
            F.aggregate("ms", F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("tokens"),
        ).alias("block"),
    )
    joined = block.groupBy("c").agg(F.array_sort(F.collect_list("block"), _block_before).alias("bs"))
    return joined.select(
        F.col("c").alias(conv),
        F.transform("bs", lambda b: F.struct(b["text"].alias("text"), b["spans"].alias("spans"))).alias("blocks"),
        F.flatten(F.transform("bs", lambda b: b["refs"])).alias("attachments"),
        F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["tokens"]).alias("expanded_tokens"),
    )


def _compare(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(0)
    for x, y in reversed(pairs):
        out = (
            F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1)).when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(out)
        )
    return out


def _before(x: Column, y: Column) -> Column:
    return _compare([(x[k], y[k]) for k in ("t", "r", "body")])


def _block_before(x: Column, y: Column) -> Column:
    return _compare([(x["b"], y["b"])])


def formatted(blocks: Column) -> Column:
    """The whole conversation as one string."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "")


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted string, escapes undone."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda _, i: i > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text"),
        ),
    )


def loss_text(blocks: Column) -> Column:
    """What stands under the loss mask, escapes undone, read from the formatted text by its spans."""
    return F.array_join(F.transform(blocks, lambda b: F.array_join(F.transform(b["spans"], lambda s: unescape(b["text"].substr(s["start"] + 1, s["length"]))), "")), "")


def chat_digests(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: Column | None = None) -> DataFrame:
    """Digests of each conversation, all read back from the formatted output.

    ``parts`` (an array of ``PART``) takes the place of the text where messages have typed content.
    ``n_attachments`` and ``expanded_tokens`` count what the placeholders stand for. Null texts
    are empty, null conversations one conversation; very long texts are digested whole; repeated
    rows are turns of their own; no rows, no conversation; other columns aren't read.
    """
    chats = format_chats(messages, text_parts(F.col(text)) if parts is None else parts, conv, turn, role)
    read = chats.select(conv, formatted(F.col("blocks")).alias("f"), loss_text(F.col("blocks")).alias("l"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens").withColumn("ts", read_turns(F.col("f")))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv,
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"),
        F.length("f").cast("long").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )
