"""Chat formatting with typed content parts.

DataFrame operations only.  A turn's content is an array of typed parts.  A
visitor over the parts (one branch for each kind) writes text parts escaped and
image, audio and document parts as placeholders, in order, and records each
attachment with its ordinal in the conversation and the tokens that its
placeholder stands for.

A turn is written ``<|role|>ROLE<|text|>CONTENT<|end|>``.  Inside roles and
texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l``.  So no text part, and
no two parts side by side, can hold or form a control string; every ``<`` of
the output begins one, and the texts can be read back exactly.

Defined cases: a null role or text is empty; a null part, or one of unknown
kind, is written as nothing; turns with equal numbers are ordered by role and
content, a null number first; repeated rows are separate turns; a null
conversation id is a conversation of its own; an empty table gives an empty
result.  A conversation is one row of the output by contract, so its turns
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
IMAGE, AUDIO, DOCUMENT = "<|image|>", "<|audio|>", "<|document|>"
#: Only these roles' texts are trained on.
LOSS_ROLES = ("assistant",)
#: Tokens that a placeholder stands for: an image's patches of 28 x 28 pixels, audio by the second, documents by the page.
PATCH, AUDIO_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
PART = "struct<kind:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>"
#: The conversation that checks the escaping.
CHECK_CONVERSATION, CHECK_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("uri"), none.cast("long").alias("width"), none.cast("long").alias("height"), none.cast("double").alias("seconds"), none.cast("long").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that stand for an attachment; missing measures count as one unit."""
    whole = lambda x, unit: F.ceil(F.coalesce(x, F.lit(1)) / F.lit(unit))
    return (
        F.when(part["kind"] == "image", whole(part["width"], PATCH) * whole(part["height"], PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE)
        .cast("long")
    )


def placeholder(part: Column) -> Column:
    return F.when(part["kind"] == "image", F.lit(IMAGE)).when(part["kind"] == "audio", F.lit(AUDIO)).when(part["kind"] == "document", F.lit(DOCUMENT))


def visit(part: Column) -> Column:
    """What a part is in the formatted text."""
    return F.coalesce(F.when(part["kind"] == "text", escaped(part["text"])).otherwise(placeholder(part)), F.lit(""))


def format_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, trained, piece, start, attachments, n_expanded) by turn for rows (conv_id, turn, role, content).

    ``start`` is where the piece begins in the conversation, in code points.
    """
    clean = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.array().cast(f"array<{PART}>")).alias("content"))
    body = F.array_join(F.transform("content", visit), "")
    found = F.filter(F.transform("content", lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens"))), lambda x: x["tokens"].isNotNull())
    head = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT))
    turns = clean.select("conv_id", "turn", "role", body.alias("body"), head.alias("head"), found.alias("attachments"), F.col("role").isin(*LOSS_ROLES).alias("trained"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("turn_no"),
        "trained",
        "piece",
        (F.sum(F.length("piece")).over(before) - F.length("piece") + F.length("head")).alias("start"),
        F.length("body").alias("length"),
        "attachments",
        F.expr("aggregate(attachments, 0L, (a, x) -> a + x.tokens)").alias("n_expanded"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_expanded): one training row for each conversation.

    ``loss_spans`` are (start, length) in code points of the formatted text.
    """
    by_turn = F.array_sort(F.collect_list(F.struct("turn_no", "piece", "trained", "start", "length", "attachments")))
    one = format_turns(messages).groupBy("conv_id").agg(by_turn.alias("turns"), F.sum("n_expanded").alias("n_expanded"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"] & (t["length"] > 0)), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    refs = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn_no"].alias("turn_no"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return one.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"), refs.alias("attachments"), "n_expanded")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): the turns (role, text, placeholders) and the text under the loss mask, from the formatted text alone and its spans.

    The pieces between spans are found by splitting at the control strings, which
    can't occur in an escaped text.  Placeholders stay in the texts as they are;
    the kinds of the real ones, in order, tell them from texts that say the same.
    """
    pieces = F.filter(F.split(F.col("formatted"), r"<\|end\|>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.substring_index(F.substring(p, len(ROLE) + 1, 2147483647), TEXT, 1)).alias("role"), unescaped(F.substring_index(p, TEXT, -1)).alias("text"), F.regexp_extract_all(p, F.lit(r"<\|(image|audio|document)\|>"), F.lit(1)).alias("placeholders")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The digests of op4, over all conversations and the one that checks the escaping."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(CHECK_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHECK_TEXT).alias("text"))
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))
    back = read_back(format_conversations(messages))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
