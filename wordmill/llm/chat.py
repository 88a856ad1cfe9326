"""Chat formatting: a finite-state machine over roles and a declarative template.

Each conversation becomes a list of text segments, each with a loss flag, and
their concatenation. Control strings inside texts are escaped reversibly, so the
turns can be read back from the formatted text alone. Only DataFrame functions.

Turns are ordered by turn, then role, then text (nulls first); a null role or
text is empty; repeated rows are repeated turns. A conversation whose order the
machine refuses is formatted all the same and marked: order_ok is false and
first_violation is the number of the first refused turn. Roles that the template
doesn't know get the general marks. Rows of a null conv_id form one conversation.
Extra columns are ignored; an empty table gives no rows. A conversation is one
row, so its turns meet in one task: its digest is of one text, in order.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role, the roles learned from, and the machine: (state, role) -> state."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "")})
    general: tuple[str, str] = ("[ROLE]", "[/ROLE] ")
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    accepting: tuple[str, ...] = ("answered",)
    reserved: tuple[str, ...] = ("[/OUT]",)  # further strings that no text may hold as they are


ESCAPE = "\\"


def _controls(t: Template) -> list[str]:
    """Every string that a reader of the format looks for, without the blanks beside it."""
    marks = [*t.marks.values(), t.general]
    return sorted({c.strip() for c in (t.begin, t.end, *t.reserved, *(m for pair in marks for m in pair)) if c.strip()})


def _codes(t: Template) -> dict[str, str]:
    """The escape character and each first character of a control string -> what stands for it.

    A code is the escape character and a letter or digit that no control string holds, so no escape makes one.
    Templates that can't be read back are an error: without an end, with the escape character in a control string,
    with one mark that starts another, or where a control string that is searched for can overlap itself.
    """
    controls, starts = _controls(t), [m[0] for m in t.marks.values()] + [t.general[0]]
    sought = [t.end, t.general[1].strip()]
    wrong = not all(sought) or any(ESCAPE in c for c in controls) or any(a.startswith(b) for i, a in enumerate(starts) for j, b in enumerate(starts) if i != j)
    wrong = wrong or any(s[:n] == s[-n:] for s in sought for n in range(1, len(s))) or any(t.end in c for c in (t.begin, *starts, *(m[1] for m in t.marks.values()), t.general[1]))
    free = [c for c in string.ascii_lowercase + string.digits + string.ascii_uppercase if not any(c in k for k in controls)]
    firsts = [ESCAPE, *sorted({c[0] for c in controls})]
    if wrong or len(free) < len(firsts):
        raise ValueError("this template can't be read back")
    return {first: ESCAPE + code for first, code in zip(firsts, free)}  # noqa: B905 - more letters are free than needed


def escape(text: Column, t: Template) -> Column:
    """No control string is left, and no escape character but those of the escapes."""
    for first, code in _codes(t).items():
        if first == ESCAPE:
            text = F.replace(text, F.lit(first), F.lit(code))
        else:
            rests = "|".join(re.escape(c[1:]) for c in _controls(t) if c[0] == first)
            text = F.regexp_replace(text, f"{re.escape(first)}(?={rests})", re.escape(code))
    return text


def unescape(text: Column, t: Template) -> Column:
    for first, code in reversed(_codes(t).items()):
        text = F.replace(text, F.lit(code), F.lit(first))
    return text


def _marks(role: Column, t: Template, side: int) -> Column:
    """What stands before or after a text of that role."""
    known = F.when(F.lit(False), F.lit(""))
    for name, marks in t.marks.items():
        known = known.when(role == name, F.lit(marks[side]))
    return known.otherwise(F.lit("") if side else F.concat(F.lit(t.general[0]), escape(role, t), F.lit(t.general[1])))


def _segments(turn: Column, t: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    before = F.concat(F.lit(t.begin), _marks(turn["role"], t, 0))
    after = F.concat(_marks(turn["role"], t, 1), F.lit(t.end))
    return F.array(segment(before, F.lit(False)), segment(escape(turn["text"], t), turn["role"].isin(*t.learned)), segment(after, F.lit(False)))


def format_chats(turns: DataFrame, t: Template | None = None) -> DataFrame:
    """conv_id, turn_count, order_ok, first_violation, segments (text, loss), formatted."""
    t = t or Template()
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", one.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)])

    def step(now: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(now["state"], F.lit(">"), turn["role"])), F.lit("refused"))
        bad = F.when(now["bad"].isNull() & (to == "refused"), now["n"]).otherwise(now["bad"])
        return F.struct(to.alias("state"), (now["n"] + 1).alias("n"), bad.alias("bad"))

    first = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    out = chats.select("conv_id", "turns", F.aggregate("turns", first, step).alias("ran"))
    out = out.withColumn("segments", F.flatten(F.transform("turns", lambda x: _segments(x, t))))
    return out.select(
        "conv_id",
        F.size("turns").alias("turn_count"),
        (F.col("ran.bad").isNull() & F.col("ran.state").isin(*t.accepting)).alias("order_ok"),
        F.col("ran.bad").alias("first_violation"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, t: Template | None = None) -> Column:
    """The turns (role, text) that a formatted text holds."""
    t = t or Template()

    def turn(part: Column) -> Column:
        inner = F.substring(part, len(t.begin) + 1, 2_147_483_647)
        sure = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("text")))
        for name, (before, after) in t.marks.items():
            text = F.substring(inner, F.lit(len(before) + 1), F.length(inner) - len(before) - len(after))
            sure = sure.when(inner.startswith(before), F.struct(F.lit(name).alias("role"), unescape(text, t).alias("text")))
        role = F.substring_index(F.substring(inner, len(t.general[0]) + 1, 2_147_483_647), t.general[1].strip(), 1)
        skip = F.length(role) + len(t.general[0]) + len(t.general[1])
        text = F.substring(inner, skip + 1, F.length(inner))
        return sure.otherwise(F.struct(unescape(role, t).alias("role"), unescape(text, t).alias("text")))

    parts = F.split(formatted, re.escape(t.end), -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(segments: Column, t: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = t or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
