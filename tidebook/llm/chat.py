"""Chat formatting from a declarative template, with DataFrame functions only.

A template names each role's opening mark, which texts the loss is taken on, the closing mark, and a finite-state
machine over roles. A conversation becomes segments, each with its loss flag; joined, they are the formatted text,
from which turns can be read back exactly. Inside texts every mark gets an escape character in front; the format itself puts
a line break before a closing mark and opens turns at line starts, so a mark without an escape in front is the format's.

Texts are escaped row by row before rows meet. A conversation is one sample and one row of the result, so its turns
come together in one task; its memory is that of its own text.

Defined cases: a null text is empty. Turns are in the order of turn (nulls first), then role, then text; repeated
rows are turns of their own. Rows with a null conv_id are one conversation. A role that the template does not name, or a
null one, gets a mark that spells it in hexadecimal (null: a minus), no loss, and breaks the turn order. Whatever breaks
the order is formatted all the same; state says "broken" and first_bad the place (from 0) of the first wrong turn. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from re import escape as quoted

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fim import check_marks


@dataclass(frozen=True)
class Turn:
    mark: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """moves: state, role, next state. Conversations are complete in the states of `complete`."""

    roles: Mapping[str, Turn] = field(default_factory=lambda: {"system": Turn("### System: "), "user": Turn("### User: "), "assistant": Turn("### Assistant: ", loss=True)})
    other: str = "### ["
    close: str = "</turn>"
    escape: str = "\\"
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    complete: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        check_marks(self.marks)
        if any("\n" in m or self.escape in m for m in self.marks):
            raise ValueError("a mark holds a line break or the escape")
        if len(self.escape) != 1 or any(s == BROKEN or t == BROKEN for s, _, t in self.moves):
            raise ValueError("the escape is one character, and no state is called broken")

    @property
    def marks(self) -> list[str]:
        return [*(t.mark for t in self.roles.values()), self.other, self.close]

    @property
    def ending(self) -> str:
        return f"\n{self.close}\n"


BROKEN = "broken"


def escaped(text: Column, template: Template) -> Column:
    """text with an escape before every mark. As marks do not overlap, their order does not matter."""
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(template.escape + m)), template.marks, text)


def unescaped(text: Column, template: Template) -> Column:
    return reduce(lambda t, m: F.replace(t, F.lit(template.escape + m), F.lit(m)), template.marks, text)


def _case(role: Column, template: Template, named, other) -> Column:
    """named(turn) for the roles of the template, else other."""
    out = None
    for name, turn in template.roles.items():
        out = F.when(role == name, named(turn)) if out is None else out.when(role == name, named(turn))
    return other if out is None else out.otherwise(other)


def state_after(roles: Column, template: Template) -> Column:
    """struct(state, n, first_bad) after all roles: the machine stays broken once no move is left."""
    pairs = [F.lit(x) for s, role, t in template.moves for x in (f"{s}\n{role}", t)]
    moves = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))

    def step(at: Column, role: Column) -> Column:
        then = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role)), F.lit(BROKEN))
        bad = F.when(at["first_bad"].isNull() & (then == BROKEN), at["n"]).otherwise(at["first_bad"])
        return F.struct(then.alias("state"), (at["n"] + 1).alias("n"), bad.alias("first_bad"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_bad"))
    return F.aggregate(roles, zero, step)


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, segments (text, loss), state, n_turns, first_bad and valid of each conversation.

    Segments are a turn's mark, its escaped text and its end, turn by turn.
    """
    rows = conversations.select("conv_id", "turn", "role", escaped(F.coalesce("text", F.lit("")), template).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    spelled = lambda role: F.concat(F.lit(template.other), F.coalesce(F.hex(role), F.lit("-")), F.lit("]: "))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        mark = _case(t["role"], template, lambda turn: F.lit(turn.mark), spelled(t["role"]))
        loss = _case(t["role"], template, lambda turn: F.lit(turn.loss), F.lit(False))
        return F.array(segment(mark, F.lit(False)), segment(t["text"], loss), segment(F.lit(template.ending), F.lit(False)))

    whole = whole.withColumn("at", state_after(F.col("turns.role"), template))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        "at.state",
        F.col("at.n").alias("n_turns"),
        "at.first_bad",
        F.col("at.state").isin(*template.complete).alias("valid"),
    )


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = Template()) -> Column:  # noqa: B008
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def turns_of(text: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns (role, text) that a formatted text was made of."""
    ends = F.split(text, quoted(template.ending), -1)
    spelled = f"^{quoted(template.other)}([0-9A-F]*|-)\\]: "

    def turn(part: Column) -> Column:
        code = F.regexp_extract(part, spelled, 1)
        role = F.when(code != "-", F.decode(F.unhex(code), "UTF-8"))
        size = F.length(code) + len(template.other) + 3
        for name, t in template.roles.items():
            role = F.when(part.startswith(t.mark), F.lit(name)).otherwise(role)
            size = F.when(part.startswith(t.mark), F.lit(len(t.mark))).otherwise(size)
        return F.struct(role.alias("role"), unescaped(F.substr(part, size + 1), template).alias("text"))

    return F.transform(F.slice(ends, 1, F.size(ends) - 1), turn)
