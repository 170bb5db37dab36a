"""Chat formatting from a declarative template, with built-in expressions only.

A ``Template`` names the control strings, the roles under loss and the turn order, given as a finite-state machine
over roles. ``format_chats`` returns one row per conversation: the segments (text, loss) in order, their
concatenation, whether the machine accepts the roles, and the first turn that it rejects. ``read_chats`` parses the
formatted text and the loss mask back.

Control strings start with ``<|``. Inside texts and roles, every ``<``, backslashes, ``|`` gets one backslash more,
so the pair ``<|`` only ever comes from the template; reading takes that backslash away again. A line feed inside
a role is written as the control string ``nl``.

Edge cases: null text and null role count as empty; rows are ordered by turn, then role, then text (nulls first), so
repeated rows are repeated turns; rows without conv_id are one conversation; conversations that break the turn order
are formatted all the same and flagged; an empty table gives no rows. A conversation is one row by contract, as a
document is; it is collected whole, never cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.shared import narrow

REJECTED = "!"


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    nl: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; "" is the state before the first turn.
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })


DEFAULT = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def first_rejected(roles: Column, template: Template = DEFAULT) -> Column:
    """Number (from 0) of the first turn that the machine rejects, or null. Only the state is carried along."""
    moves = [(s, r, t) for s, row in template.order.items() for r, t in row.items()]

    def step(acc: Column, role: Column) -> Column:
        after = F.lit(REJECTED)
        for state, given, target in moves:
            after = F.when((acc["state"] == state) & (role == given), F.lit(target)).otherwise(after)
        # Past a rejected turn nothing moves, so passed stays at that turn's number.
        return F.struct(after.alias("state"), F.when(after == REJECTED, acc["passed"]).otherwise(acc["passed"] + 1).alias("passed"))

    last = F.aggregate(roles, F.struct(F.lit("").alias("state"), F.lit(0).alias("passed")), step)
    return F.when(last["state"] == REJECTED, last["passed"])


def format_chats(chats: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, invalid_at)."""
    turns = narrow(chats, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit(template.nl))
        return F.array(
            F.struct(F.concat(F.lit(template.start), role, F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    rows = rows.select(
        "conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"),
        first_rejected(F.transform("turns", lambda t: t["role"]), template).alias("invalid_at"))
    return rows.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "invalid_at")


def read_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted, invalid_at), parsed from the output."""
    shape = f"(?s)^{_literal(template.start)}([^\\n]*)\\n(.*)$"

    def parse(part: Column) -> Column:
        role = F.replace(F.regexp_extract(part, shape, 1), F.lit(template.nl), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.regexp_extract(part, shape, 2)).alias("text"))

    parts = F.split("formatted", _literal(template.end + "\n"))
    under = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id", F.transform(F.slice(parts, 1, F.size(parts) - 1), parse).alias("turns"),
        F.transform(under, lambda s: unescape(s["text"])).alias("loss_texts"), "formatted", "invalid_at")


def digests(read: DataFrame) -> DataFrame:
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("invalid_at").cast("bigint").alias("invalid_at"))
