"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log row is ``conv_id, seq, message, kind, role, text``.  Logs are partitioned by conversation and sorted by
sequence; the events of a message are folded into its final text:

``start``       opens the message (with a first text, or none)
``delta``       appends streamed text
``edit``        replaces everything before it
``regenerate``  discards everything before it; the deltas after it are the new answer
``delete``      removes the message, unless a later edit or regeneration brings it back

Messages follow the sequence of their first event.  The template marks turns, and control strings inside
roles and texts are broken by a reversible escape, so that the output can be read back.

Edge cases: a null text is empty, a null role is the empty role; null conversation ids are one conversation,
null sequences come first; events with equal sequence are ordered by kind, then text; an empty log gives no
row; extra columns are ignored.  A conversation is one task and one row, as its formatted text is one string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of the template and of common chat formats; ``<|`` covers every ``<|name|>``.
CONTROL = ("<|", "<</SYS>>", "<<SYS>>", "</s>", "<s>", "[/INST]", "[INST]")
KINDS = ("start", "regenerate", "edit", "delta", "delete")
_MARK = {"<": "\\1", "[": "\\2"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_MARK[c[0]] + c[1:])), CONTROL, out)


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: a backslash is always followed by its digit, so plain replacements suffice."""
    for plain, mark in [*((k, v) for k, v in _MARK.items()), ("\\", "\\0")]:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the final messages; ``place`` orders them within a conversation."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).cast("int")
    event = log.select("conv_id", "message", F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("at"),
                       "kind", "role").repartition("conv_id")
    message = Window.partitionBy("conv_id", "message")
    whole = event.withColumns({
        "reset": F.max(F.when(F.col("kind").isin("start", "edit", "regenerate"), F.col("at"))).over(message),
        "gone": F.max(F.when(F.col("kind") == "delete", F.col("at"))).over(message),
        "first": F.min("at").over(message),
        "speaker": F.min(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(message)["role"],
    })
    alive = whole.where((F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
                        & (F.col("gone").isNull() | F.coalesce(F.col("reset") > F.col("gone"), F.lit(False))))
    parts = F.sort_array(F.collect_list(F.when(F.col("kind") != "delete", F.col("at"))))
    return (alive.groupBy("conv_id", "message")
            .agg(F.min(F.struct("first", "message")).alias("place"), F.first("speaker").alias("role"),
                 F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"))
            .select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), "text"))


def format_chats(log: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: ``conv_id, formatted, loss_spans``; spans are offsets in code points."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    turn = fold_events(log).select("conv_id", "place", F.col("role").isin(*loss_roles).alias("learned"), head.alias("head"),
                                   escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = turn.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("place", F.concat("head", "body", F.lit(END)).alias("text"),
                     F.when(F.col("learned"), F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))).alias("span"))
    return (placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
            .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
                    F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans")))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    whole = F.split(formatted, END.replace("|", r"\|"), -1)
    turns = F.slice(whole, 1, F.size(whole) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, BODY, 1)
        text = F.substring(t, F.length(role) + F.lit(len(BODY) + 1), F.length(t))
        return F.struct(unescape(F.substring(role, F.lit(len(TURN) + 1), F.length(role))).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def text_under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))


def log_of_turns(turns: DataFrame) -> DataFrame:
    """Event log that leads to a table of finished turns (``conv_id, turn, role, text``), as streaming would have written it.

    Each row is a message in one of four histories, dealt by conversation and place: streamed in pieces; a draft
    edited and completed; a draft discarded by a regeneration; a deleted draft brought back.  Every history folds
    to the row's text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("message"))
    third = F.floor(F.length("text") / 3).cast("int")
    first, second, rest = F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.length("text"))
    none = F.lit(None).cast("string")

    def events(*steps: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps)])

    history = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)) + F.col("message"), F.lit(4))
    log = (F.when(history == 0, events(("start", first), ("delta", second), ("delta", rest)))
           .when(history == 1, events(("start", rest), ("delta", first), ("edit", first), ("delta", second), ("delta", rest)))
           .when(history == 2, events(("start", none), ("delta", second), ("regenerate", none), ("delta", first), ("delta", F.concat(second, rest))))
           .otherwise(events(("start", first), ("delete", none), ("regenerate", F.concat(first, second)), ("delta", rest))))
    return rows.withColumn("e", F.explode(log)).select(
        "conv_id", (F.col("message") * 8 + F.col("e.k")).alias("seq"), "message", "e.kind",
        F.when(F.col("e.k") == 0, F.col("role")).alias("role"), "e.text")
