"""Chat formatting: a finite-state machine over roles and a declarative template.

DataFrame functions only.  The template lists the control strings around a turn, the
machine's transitions and the roles whose text is learned.  Every turn emits three
segments: its header, its text, its end; only the text of a learned role has the loss flag.
Texts and roles are escaped so that no control string can occur inside them:
``\\`` becomes ``\\\\`` and then ``<|`` becomes ``<\\|``.  All control strings begin with
``<|``, and a single backslash between ``<`` and ``|`` can only stem from the second step,
so undoing the steps in reverse order restores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    """Control strings, transitions (state, role) -> state, and the learned roles."""

    turn: str = "<|im_start|>"
    text: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        (START, "system"): "briefed", (START, "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})

    def __post_init__(self):
        if any(not c.startswith("<|") or "\\" in c or c.count("<|") != 1 for c in (self.turn, self.text, self.end)):
            raise ValueError("a control string starts with its only <| and has no backslash")


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, state, valid, segments, formatted.

    ``turns`` has conv_id, turn, role and text; other columns are left out.  Turns are
    ordered by turn, then role, then text (nulls first); repeated rows stay.  Null role or
    text is empty; a null conv_id is a conversation of its own; an empty table gives no
    rows.  ``state`` is where the machine ends; after a turn that no transition allows it is
    ``error`` and ``valid`` is false, but every turn is still formatted.  ``segments`` holds
    (text, loss) in order; ``formatted`` is their concatenation.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                            F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])

    def step(state: Column, turn: Column) -> Column:
        return F.coalesce(F.element_at(moves, F.concat(state, F.lit(" "), turn["role"])), F.lit(ERROR))

    def emit(turn: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        header = F.concat(F.lit(template.turn), escape(turn["role"]), F.lit(template.text))
        learned = turn["role"].isin(*template.learned) if template.learned else F.lit(False)
        return F.array(segment(header, F.lit(False)), segment(escape(turn["text"]), learned),
                       segment(F.lit(template.end), F.lit(False)))

    state = F.aggregate("turns", F.lit(START), step)
    return (chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), state.alias("state"),
                         F.flatten(F.transform("turns", emit)).alias("segments"))
            .select("conv_id", "n_turns", "state", (F.col("state") != ERROR).alias("valid"), "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The (role, text) pairs of a formatted conversation, unescaped."""
    bodies = F.split(formatted, re.escape(template.turn), -1)
    bodies = F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0)))

    def read(body: Column) -> Column:
        sides = F.split(body, re.escape(template.text), 2)
        text = F.split(sides[1], re.escape(template.end), 2)[0]
        return F.struct(unescape(sides[0]).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, read)


def learned_text(segments: Column) -> Column:
    """All text under the loss flag, unescaped, nothing between."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescape(s["text"])), "")
