"""Conversations as formatted training text with loss flags, in column expressions only.

A template is data: three control strings, the states of a finite-state machine over roles, and whether a role's text
counts for the loss. The machine runs as a fold over a conversation's turns; texts become segments, and the formatted
text is their concatenation, so a flag covers exactly its segment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """`moves` holds (state, role): next state; a conversation is valid if it ends in one of `ends`.

    All control strings must begin with `<|`, which escaping keeps out of texts and roles.
    """

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    begin: str = "begin"
    ends: tuple[str, ...] = ("answered",)
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("begin", "system"): "briefed",
        ("begin", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })


CHAT = Template()
WRONG = "wrong"             # the state that no move leaves


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one between `<` and `|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def _next(template: Template) -> Callable[[Column, Column], Column]:
    def move(state: Column, turn: Column) -> Column:
        out = F.lit(WRONG)
        for (at, role), to in template.moves.items():
            out = F.when((state == at) & (turn["role"] == role), F.lit(to)).otherwise(out)
        return out
    return move


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, valid, segments, formatted) of each conversation of `turns` (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; a null turn comes first, null roles and texts are empty. Rows
    without a conversation id are one conversation with a null id. Repeated rows are turns of their own. A
    conversation whose roles break the template's order is formatted like any other and marked not valid; a caller
    filters on it. Extra columns are not read; an empty table gives no rows. A conversation is one row of the result,
    so its turns meet in one task and must fit there.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    role = F.coalesce("role", F.lit("")).alias("role")
    chats = turns.select("conv_id", F.struct("turn", role, text).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text_: Column, loss: Column) -> Column:
        return F.struct(text_.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.start), escape(t["role"]), F.lit(template.middle)), no),
        segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.end + "\n"), no))))
    state = F.aggregate("turns", F.lit(template.begin), _next(template))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.ends).alias("valid"), segments.alias("segments")
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) that a formatted text holds."""
    marked = F.split(formatted, _quoted(template.start))

    def turn(part: Column) -> Column:
        two = F.split(part, _quoted(template.middle))
        return F.struct(unescape(two[0]).alias("role"), unescape(F.substring_index(two[1], template.end, 1)).alias("text"))

    return F.transform(F.slice(marked, 2, F.size(marked)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
