"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A ``Template`` declares, per role, the marks around a turn and whether its text is learnt,
and which role may follow which state. Everything is built-in expressions: the machine is
a fold over a conversation's roles. A conversation is one training example, so it is one
row; conversations are spread over tasks by their id.

Marks that occur inside a text are escaped: backslashes are doubled, and a backslash is put
after the first character of every mark. No mark contains a backslash, so none is left
whole in an escaped text, and dropping one backslash before any character restores it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import text_of

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a turn, and whether the text is learnt."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, marks of any other role (around its name and text), and the machine.

    ``follows`` maps a state (``start`` or the last role) to the roles that may come next;
    ``final`` lists the states a conversation may end in.
    """

    roles: Mapping[str, Marks]
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    final: tuple[str, ...] = ()

    def __post_init__(self):
        marks = self.marks()
        for mark in marks:
            if len(mark) < 2 or "\\" in mark:
                raise ValueError(f"a mark needs two characters and no backslash: {mark!r}")
        if len({m.opening for m in self.roles.values()} | {self.other[0]}) <= len(self.roles):
            raise ValueError("every role needs an opening mark of its own")
        for a in marks:  # else a text's edge and the mark next to it could spell a mark
            for b in marks:
                for k in range(1, len(a)):
                    if b.startswith(a[k:]) or b.endswith(a[:k]):
                        raise ValueError(f"marks {a!r} and {b!r} can run into one another")

    def marks(self) -> list[str]:
        pairs = [(m.opening, m.closing) for m in self.roles.values()]
        return [*dict.fromkeys(mark for pair in (*pairs, self.other) for mark in pair)]


LLAMA_LIKE = Template(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("<s>", "</s>", loss=True),
    },
    follows={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    final=("assistant",),
)


def format_chat(
    turns: DataFrame,
    template: Template = LLAMA_LIKE,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``end_state``, ``segments``.

    ``segments`` is an array of ``(text, loss)`` whose texts, joined, are the formatted
    conversation; only the escaped text of a role with ``loss`` is flagged. Turns are taken
    by ``turn``, ties by role and text; a repeated row is a repeated turn. NULL text and role
    are empty, a NULL turn comes first, and rows without a conversation id form one
    conversation with a NULL id. A conversation out of turn order, or one that ends in no final state, is
    formatted like any other and marked not ``valid``. Other columns are ignored; an empty
    table gives no row.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
        ).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    grouped = grouped.withColumn("end_state", _end_state(F.col("rows")["role"], template))
    segments = F.flatten(F.transform("rows", lambda r: _segments(r["role"], r["text"], template)))
    return grouped.select(
        "conv_id",
        F.size("rows").cast("bigint").alias("n_turns"),
        F.col("end_state").isin(*template.final).alias("valid"),
        "end_state",
        segments.alias("segments"),
    )


def _end_state(roles: Column, template: Template) -> Column:
    steps = [F.lit(x) for state, nexts in template.follows.items() for r in nexts for x in (f"{state}\n{r}", r)]
    table = F.create_map(*steps)

    def step(state, role):
        return F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit(BROKEN))

    return F.aggregate(roles, F.lit(START), step)


def _segments(role: Column, text: Column, template: Template) -> Column:
    def segment(content: Column, loss: bool = False) -> Column:
        return F.struct(content.alias("text"), F.lit(loss).alias("loss"))

    before, says, after = template.other
    chosen = F.array(
        segment(F.concat(F.lit(before), escape(role, template), F.lit(says))),
        segment(escape(text, template)),
        segment(F.lit(after)),
    )
    for name, marks in template.roles.items():
        own = F.array(
            segment(F.lit(marks.opening)),
            segment(escape(text, template), marks.loss),
            segment(F.lit(marks.closing)),
        )
        chosen = F.when(role == name, own).otherwise(chosen)
    return chosen


def _any_mark(marks: list[str]) -> str:
    return "|".join(re.escape(mark) for mark in marks)


def escape(text: Column, template: Template) -> Column:
    """Text without any mark of the template; ``unescape`` restores it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?={_any_mark(template.marks())})(.)", "$1\\\\")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(segments: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(segments["text"], "")


def read_turns(text: Column, template: Template = LLAMA_LIKE) -> Column:
    """Roles and texts read back from a formatted conversation, as an array of structs."""
    openings = [m.opening for m in template.roles.values()] + [template.other[0]]
    before, says, after = template.other

    def read(turn):
        def inner(opening: str, closing: str) -> Column:
            length = F.length(turn) - len(opening) - len(closing)
            return F.substring(turn, F.lit(len(opening) + 1), length)

        body = inner(before, after)
        name = F.substring_index(body, says, 1)
        said = F.substring(body, F.length(name) + len(says) + 1, F.length(body))
        role, content = unescape(name), unescape(said)
        for known, marks in template.roles.items():
            mine = turn.startswith(marks.opening)
            role = F.when(mine, F.lit(known)).otherwise(role)
            content = F.when(mine, unescape(inner(marks.opening, marks.closing))).otherwise(content)
        return F.struct(role.alias("role"), content.alias("text"))

    return F.transform(F.split(text, f"(?={_any_mark(openings)})"), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    flagged = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(flagged, lambda s: unescape(s["text"])), "")
