"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template gives each role its marks and says whether its text is under the loss. Marks that occur inside a text are
escaped, reversibly, so that what is formatted can be read back turn by turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How turns of a role begin and end, and whether their text is under the loss."""

    begin: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the marks around a turn of any other role, and the turn orders that are valid."""

    turns: tuple[tuple[str, Turn], ...]
    other_begin: str
    other_mid: str
    other_end: str
    moves: tuple[tuple[str, str], ...]
    ends: tuple[str, ...]
    marks: tuple[str, ...]


#: ``moves`` are (state, role), the next state is the role; a conversation may stop in one of ``ends``.
DEFAULT = Template(
    turns=(
        ("system", Turn("<<SYS>>\n", "\n<</SYS>>")),
        ("user", Turn("<s>[INST] ", " [/INST]")),
        ("assistant", Turn("<out> ", " </s>", loss=True)),
    ),
    other_begin="<<TURN ",
    other_mid=">>\n",
    other_end="\n<</TURN>>",
    moves=(
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    ),
    ends=("user", "assistant"),
    marks=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<out>", "<<TURN", "<</TURN>>", ">>"),
)


def _code(mark: str) -> str:
    """A mark with its first character as a code; codes begin with an ampersand, and so never look like a mark."""
    return f"&#{ord(mark[0])};{mark[1:]}"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for m in sorted(template.marks, key=len, reverse=True):
        out = F.replace(out, F.lit(m), F.lit(_code(m)))
    return out


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    out = text
    for first in sorted({m[0] for m in template.marks}):
        out = F.replace(out, F.lit(f"&#{ord(first)};"), F.lit(first))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _case(role: Column, value, template: Template, other) -> Column:
    out = None
    for name, turn in template.turns:
        out = (F.when if out is None else out.when)(role == name, value(turn))
    return out.otherwise(other)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``(conv_id, valid, segments, formatted)``, a row for each conv_id in ``turns (conv_id, turn, role, text)``.

    ``segments`` are the pieces of ``formatted`` in order, ``(text, loss)``; ``valid`` tells if the roles come in an
    order that the template's machine accepts. Rows go by turn; ties by role and text, a null turn first; repeated
    rows are turns of their own. A null text or role is empty; an unknown role keeps its name inside the other marks;
    a null conv_id is a conversation. All turns of a conversation make one string, so they meet in one row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    begin = lambda r: _case(r, lambda t: F.lit(t.begin), template, F.concat(F.lit(template.other_begin), escape(r, template), F.lit(template.other_mid)))
    end = lambda r: _case(r, lambda t: F.lit(t.end), template, F.lit(template.other_end))
    loss = lambda r: _case(r, lambda t: F.lit(t.loss), template, F.lit(False))
    piece = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(begin(t["role"]), F.lit(False)), piece(escape(t["text"], template), loss(t["role"])), piece(end(t["role"]), F.lit(False))
            ),
        )
    )

    def move(state: Column, t: Column) -> Column:
        goes = [(state == a) & (t["role"] == b) for a, b in template.moves]
        allowed = goes[0]
        for g in goes[1:]:
            allowed = allowed | g
        return F.when(allowed, t["role"]).otherwise(F.lit("invalid"))

    state = F.aggregate("turns", F.lit("start"), move)
    return convs.select("conv_id", state.isin(*template.ends).alias("valid"), segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Adds ``turns``, an array of ``(role, text, loss)`` that is read from ``formatted`` alone."""
    forms = [re.escape(t.begin) + ".*?" + re.escape(t.end) for _, t in template.turns]
    forms.append(re.escape(template.other_begin) + ".*?" + re.escape(template.other_mid) + ".*?" + re.escape(template.other_end))
    pattern = "(?s)" + "|".join(forms)

    def inner(m: Column, begin: str, end: str) -> Column:
        return F.substring(m, F.lit(len(begin) + 1), F.length(m) - len(begin) - len(end))

    def turn(m: Column) -> Column:
        made = lambda role, text, loss: F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"), F.lit(loss).alias("loss"))
        named = inner(m, template.other_begin, template.other_end)
        at = F.instr(named, template.other_mid)
        other = made(
            F.substring(named, F.lit(1), at - 1),
            F.substring(named, at + len(template.other_mid), F.length(named)),
            False,
        )
        out = None
        for name, t in template.turns:
            out = (F.when if out is None else out.when)(F.startswith(m, F.lit(t.begin)), made(F.lit(name), inner(m, t.begin, t.end), t.loss))
        return out.otherwise(other)

    found = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0))
    return formatted.withColumn("turns", F.transform(found, turn))
