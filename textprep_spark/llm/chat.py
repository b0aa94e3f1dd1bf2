"""Chat formatting: event logs to final messages, messages to one training text each conversation.

``reconstruct`` folds a log of events. An event has a conversation, a place in it (``seq``), the
message it belongs to, a kind, and a text:

* ``message`` opens a message with its role and text;
* ``delta`` adds its text to the message's end, as streaming does;
* ``edit`` replaces the message's text;
* ``regenerate`` starts the text again, for the deltas that follow.

Events of one message are brought together first and folded in order of ``seq``, so a conversation
of any length is spread over tasks until its finished messages are joined.

``render`` writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside a text, ``<|`` and its
own escaped forms get one backslash more (``<|`` is written ``<\\|``), in a role ``\\``, line feed and
``|`` are written ``\\s``, ``\\n`` and ``\\p``; so no text or role holds a control string, and reading back
is exact. ``pieces`` is the text cut in parts, each with or without loss: assistant texts have it.

Null text and role count as empty. Events of a null conversation are one conversation, those of a
null message one message. A null ``seq`` comes first. Events of equal ``seq`` come in the order of the
kinds above, then by role and text; repeated rows count each. A first event that opens nothing opens
a message without text. Messages stand where they were opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
START, END = "<|im_start|>", "<|im_end|>\n"


def _empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _fold(events: Column) -> Column:
    """The messages of one message id's sorted events."""
    n = F.size(events)
    opening = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at(events, i)["kind"] == KINDS.index("message")),
    )

    def message(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at(opening, k + 2) - 1, n)
        part = F.slice(events, start, end - start + 1)
        again = F.filter(
            F.sequence(F.lit(1), F.size(part)),
            lambda j: F.element_at(part, j)["kind"] != KINDS.index("delta"),
        )
        kept = F.slice(part, F.coalesce(F.array_max(again), F.lit(1)), F.size(part))
        roles = F.filter(part, lambda e: e["role"] != "")
        return F.struct(
            F.element_at(part, 1)["seq"].alias("seq"),
            _empty(F.try_element_at(roles, F.lit(1))["role"]).alias("role"),
            F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
        )

    return F.transform(opening, message)


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, messages) from ``events`` (conv_id, seq, message_id, kind, role, text).

    ``messages`` is an array of (seq, role, text) in order.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    event = F.struct(
        "seq",
        F.coalesce(kind, F.lit(1)).alias("kind"),
        _empty(F.col("role")).alias("role"),
        _empty(F.col("text")).alias("text"),
    )
    single = events.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(event)).alias("events")
    )
    folded = single.select("conv_id", _fold(F.col("events")).alias("some"))
    return folded.groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list("some"))).alias("messages")
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("\\", "\\s"), ("\n", "\\n"), ("|", "\\p")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("|", "\\p"), ("\n", "\\n"), ("\\", "\\s")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, pieces) from (conv_id, messages); ``pieces`` are (text, loss)."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(message: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(START), escape_role(message["role"]), F.lit("\n")), F.lit(False)),
            piece(escape(message["text"]), message["role"] == learned),
            piece(F.lit(END), F.lit(False)),
        )

    cut = conversations.select("conv_id", F.flatten(F.transform("messages", of)).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return cut.select("conv_id", text.alias("formatted"), "pieces")


def read_back(formatted: Column) -> Column:
    """The (role, text) of every turn of a formatted text."""
    turns = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        size = F.length(t) - F.length(role) - 1 - len(END)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substr(t, F.length(role) + 2, size)).alias("text"),
        )

    return F.transform(turns, turn)


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    parts = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(parts, lambda p: unescape(p["text"])), "")
