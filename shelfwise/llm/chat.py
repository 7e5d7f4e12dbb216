"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted (turn, then role and text, so ties have one order), merged
where adjacent turns have the same role, and concatenated:

    <turn role>TEXT<next>TEXT</turn>

followed by a line feed. One ``<turn>`` block holds adjacent turns of one role, parted by ``<next>``. Inside roles and
texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``; no control string can occur there, and the
original comes back exactly. ``mask`` cuts the formatted text into pieces with their length in code points and a loss
flag: exactly the texts of assistant turns are under the loss.

A NULL text or role counts as empty, a NULL conv_id is one conversation, a NULL turn sorts first; repeated rows are
turns of their own. A conversation is one output string, so its turns have to meet in one row; the rows before that
are spread by Spark's shuffle, and every step after it is linear in the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, OPEN_END, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """The text without any character of a control string."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``mask`` (array of length and loss flag)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("__t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("__t")).alias("__turns"))
    t = F.col("__turns")
    same = lambda x, i, step: F.coalesce(x["role"] == F.get(t, i + step)["role"], F.lit(False))
    piece = lambda x, i: F.struct(
        F.when((i > 0) & same(x, i, -1), F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(x["role"]), F.lit(OPEN_END))).alias("before"),
        escape(x["text"]).alias("body"),
        F.when(same(x, i, 1), F.lit("")).otherwise(F.lit(CLOSE)).alias("after"),
        (x["role"] == LOSS_ROLE).alias("loss"),
    )
    chats = chats.select("conv_id", F.transform(t, piece).alias("__p"))
    span = lambda c, flag: F.struct(F.length(c).alias("chars"), flag.alias("loss"))
    mask = F.flatten(
        F.transform("__p", lambda p: F.array(span(p["before"], F.lit(False)), span(p["body"], p["loss"]), span(p["after"], F.lit(False))))
    )
    formatted = F.array_join(F.transform("__p", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    return chats.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: ``conv_id`` and ``turns`` (array of role, text and loss flag), from the output only.

    The loss flag of a turn is its piece of the mask; the pieces are checked to lie where the text says.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")
    in_block = lambda b: F.transform(
        F.split(F.regexp_replace(b, "^<turn [^>]*>", ""), NEXT),
        lambda x: F.struct(
            F.regexp_extract(b, "^<turn ([^>]*)>", 1).alias("role"),
            x.alias("body"),
        ),
    )
    parsed = formatted.withColumn("__b", F.flatten(F.transform(blocks, in_block)))
    flag = lambda x, i: F.struct(
        unescape(x["role"]).alias("role"),
        unescape(x["body"]).alias("text"),
        F.get(F.col("mask"), 3 * i + 1)["loss"].alias("loss"),
        (F.get(F.col("mask"), 3 * i + 1)["chars"] == F.length(x["body"])).alias("fits"),
    )
    return parsed.select("conv_id", F.transform("__b", flag).alias("turns"), F.length("formatted").cast("long").alias("chars"))


def chat_report(turns: DataFrame) -> DataFrame:
    """What the output says of every conversation, read back from it."""
    parsed = parse_chats(format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"] & t["fits"]), lambda t: t["text"]), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    parsed = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("__whole"), loss.alias("__loss"), "chars")
    return parsed.select(
        "conv_id",
        "n_turns",
        digest(F.col("__whole")).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        digest(F.col("__loss")).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
