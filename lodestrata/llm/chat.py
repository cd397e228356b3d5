"""Chat formatting: a role automaton and a declarative template, on Spark functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """What stands around a role's text, and whether the text is trained on."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role; ``other`` holds a role without an entry, named between ``named``.

    ``moves`` are the automaton's allowed steps from one role to the next.
    """

    turns: dict[str, Turn]
    other: Turn
    named: str
    start: str
    moves: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    @property
    def controls(self) -> list[str]:
        found = [c for t in [*self.turns.values(), self.other] for c in (t.opening, t.closing)] + [self.named]
        return list(dict.fromkeys(found))


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("<<TURN>>", "<</TURN>>"),
    named="<</ROLE>>",
    start="start",
    moves=frozenset({("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}),
)


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings: backslashes are doubled, and a single one
    goes behind the first character of each control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(2 * ESCAPE))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column, template: Template) -> Column:
    """The inverse of ``escape``."""
    for c in reversed(template.controls):
        text = F.replace(text, F.lit(c[0] + ESCAPE + c[1:]), F.lit(c))
    return F.replace(text, F.lit(2 * ESCAPE), F.lit(ESCAPE))


def _segments(turn: Column, template: Template) -> Column:
    """Opening, text and closing of one turn, with their loss flags."""
    part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    body = escape(turn["text"], template)
    other = template.other
    out = F.array(part(F.concat(F.lit(other.opening), escape(turn["role"], template), F.lit(template.named)), False), part(body, other.loss), part(F.lit(other.closing), False))
    for role, t in template.turns.items():
        out = F.when(turn["role"] == role, F.array(part(F.lit(t.opening), False), part(body, t.loss), part(F.lit(t.closing), False))).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, segments, formatted, valid.

    ``segments`` is an array of (text, loss) in order; ``formatted`` is all of
    them joined. ``valid`` says whether the automaton accepts the turn order;
    conversations that it rejects are formatted as they are. Null texts and
    roles count as empty; turns with equal (or null, first) numbers are ordered
    by role and text, and repeated rows all stay. A role without an entry in
    the template is written by name. A null id is a conversation of its own.
    A conversation is one value of the result, so its turns meet in one task.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))))
    moves = F.create_map(*(F.lit(x) for a, b in sorted(template.moves) for x in (f"{a}>{b}", b)))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("rejected")))
    return (
        rows.groupBy(conv)
        .agg(turns.alias("turns"))
        .select(conv, F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"), (state != "rejected").alias("valid"))
        .select(conv, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    import re

    ends = "|".join(re.escape(t.closing) for t in [*template.turns.values(), template.other])
    parts = F.filter(F.split(formatted, ends), lambda p: p != "")
    behind = lambda p, c: F.substring(p, F.lit(len(c) + 1), F.length(p))

    def one(p: Column) -> Column:
        rest = behind(p, template.other.opening)
        out = F.struct(
            unescape(F.substring_index(rest, template.named, 1), template).alias("role"),
            unescape(F.substring_index(rest, template.named, -1), template).alias("text"),
        )
        for role, t in template.turns.items():
            out = F.when(F.startswith(p, F.lit(t.opening)), F.struct(F.lit(role).alias("role"), unescape(behind(p, t.opening), template).alias("text"))).otherwise(out)
        return out

    return F.transform(parts, one)


def read_loss(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
