"""Chat formatting with Spark expressions only, and reading it back.

A conversation is one string of blocks, each
    <|im_start|>ROLE newline TEXT <|im_sep|> TEXT ... <|im_end|> newline
where a block holds the texts of adjacent turns of one role. Inside roles and texts, each
``<|`` is written ``<\\|``, and any run of backslashes between ``<`` and ``|`` gets one more, so
no text can hold a marker and the text comes back by taking one off. A line end in a role is
written ``<|nl|>``. The loss mask covers the
texts of assistant blocks, without markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, running, with_value

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def formatted(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(id, ``formatted``, ``loss_spans``): one row per conversation.

    Turns are sorted by number, then role and text, nulls first; rows of equal number stay
    apart. Null roles and texts count as empty; rows of a null id form one conversation.
    ``loss_spans`` are (start, length) in code points, one for each text of the loss role.
    Extra columns are not read; an empty table gives an empty result. A conversation is one
    string, so the longest has to fit one row; nothing larger meets in a task, as groups are
    hashed by conversation.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.replace(escaped(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit(LINE)).alias("role"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    grouped = conversations.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a turn opens a block unless the turn before has its role; what stands before and after its text follows from that
    joins = F.transform("turns", lambda t, i: F.get("turns", i - 1)["role"].eqNullSafe(t["role"]))
    grouped = grouped.withColumn("joins", joins)
    head = lambda t, i: F.when(F.get("joins", i), F.lit(SEP)).otherwise(F.concat(F.lit(START), t["role"], F.lit("\n")))
    tail = lambda i: F.when(F.coalesce(F.get("joins", i + 1), F.lit(False)), F.lit("")).otherwise(F.lit(END + "\n"))
    parts = F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), t["text"].alias("text"), tail(i).alias("tail"), t["role"].alias("role")))
    grouped = grouped.select("id", parts.alias("parts"))

    # where each turn's text stands follows from running sums of the lengths
    def masked(ends: Column) -> Column:
        span = lambda p, i: F.struct(p["role"].alias("role"), (F.get(ends, i) - F.length(p["tail"]) - F.length(p["text"])).alias("start"), F.length(p["text"]).alias("length"))
        mine = F.filter(F.transform("parts", span), lambda s: s["role"] == F.lit(loss_role))
        return F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    sizes = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"]))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return grouped.select(F.col("id").alias(id_col), whole.alias("formatted"), with_value(running(sizes), masked).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``, an array of (role, text), and ``loss``, the texts under the mask: both from ``formatted``.

    Each takes time near linear in a conversation. A null ``formatted`` gives nulls, one without blocks no turns.
    """

    def opened(block: Column) -> Column:
        body = F.regexp_replace(block, r"<\|im_end\|>\n\z", "")
        at = F.instr(body, "\n")
        role = F.replace(F.substring(body, F.lit(1), at - 1), F.lit(LINE), F.lit("\n"))
        texts = F.split(F.substring(body, at + 1, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    blocks = lambda whole: F.filter(F.split(whole, r"<\|im_start\|>", -1), lambda b: b != "")
    masked = lambda whole: F.transform(pieces(whole, F.col("loss_spans")), unescaped)
    # the string is bound once, as an expression that is named inside a lambda is made anew for each of its values
    turns = with_value(F.col("formatted"), lambda whole: F.flatten(F.transform(blocks(whole), opened)))
    return chats.withColumns({"turns": turns, "loss": with_value(F.col("formatted"), lambda whole: F.array_join(masked(whole), ""))})
