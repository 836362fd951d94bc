"""Chat formatting from a declarative template (operator 13).

A template says which segments a turn becomes, which of them bear the loss, and which roles
may follow which: a finite-state machine whose state is the last role. Each turn is emitted
as its segments with a loss flag each, and whether the machine allows it; turns that it
doesn't allow are formatted too, and the machine goes on from them. What stands in a text or
a role can't be taken for a mark: one backslash is put into each `<`, backslashes, `|`, which
is undone by taking one away, so that no `<|` remains; in a role, whose end is a line end,
backslashes, bars and line ends are written as two characters.

Formatting is native. A reader takes the segments back: it joins a turn's segments, parses
them by the marks, undoes the escapes and hashes, turn after turn.

Defined cases: a null text or role is empty; a null id is a conversation of its own; rows are
in order of turn (nulls first), then role, then text, repeated rows stay; other columns may
have any name and are not read; an empty table gives none. A text is never cut and never held
with another conversation's; a conversation's turns pass one after another through one task,
as its hash does by nature, and only its sort, which spills, grows with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .turns import Digest, batches_of, conversations, streamed

ROLE, TEXT = "{role}", "{text}"


@dataclass(frozen=True)
class Template:
    """Segments of a turn, the roles whose text bears the loss, and the moves of the machine.

    moves: from the last role ("" at the start) the roles that may follow; ends: roles after
    which a conversation may end. The segments are marks but for ROLE and TEXT, once each.
    """

    segments: tuple[str, ...] = ("<|im_start|>", ROLE, "\n", TEXT, "<|im_end|>\n")
    trained: tuple[str, ...] = ("assistant",)
    moves: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if [s for s in self.segments if s in (ROLE, TEXT)] != [ROLE, TEXT]:
            raise ValueError("a turn has one role, then one text")
        after_role, after_text = self.segments[self.segments.index(ROLE) + 1], self.segments[self.segments.index(TEXT) + 1 :]
        if after_role == TEXT or after_role[0] not in "\n|" or not after_text or not after_text[0].startswith("<|"):
            raise ValueError("a role ends at a line end or a bar, a text at a mark that starts with <|")

    @property
    def pattern(self) -> str:
        """A turn as a regular expression with the groups role and text."""
        groups = {ROLE: "(?P<role>.*?)", TEXT: "(?P<text>.*?)"}
        return "".join(groups.get(s) or re.escape(s) for s in self.segments)


CHATML = Template()


def escape(text: Column) -> Column:
    """One backslash more before the bar of each `<`, backslashes, `|`: no `<|` remains."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def allowed(last: Column, role: Column, moves: Mapping[str, tuple[str, ...]]) -> Column:
    """Whether the machine may take role after last; last is null at the start."""
    pairs = [F.concat(F.lit(f"{a}\n"), F.lit(b)) for a, follow in moves.items() for b in follow]
    return F.concat(F.coalesce(last, F.lit("")), F.lit("\n"), role).isin(*pairs) & ((last != "") | last.isNull())


def format_turns(rows: DataFrame, template: Template = CHATML, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, nth, legal, segments) for each row: segments are (text, loss), legal is the machine's answer.

    nth counts a conversation's turns from 1. A turn is legal if its role may follow the one
    before and, where it is the last, a conversation may end with it.
    """
    plain = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = plain.select("*", F.row_number().over(order).cast("long").alias("nth"), F.lag("role").over(order).alias("last"), F.lead("role").over(order).alias("next"))
    legal = allowed(F.col("last"), F.col("role"), template.moves) & (F.col("next").isNotNull() | F.col("role").isin(*template.ends))
    values = {ROLE: escape_role(F.col("role")), TEXT: escape(F.col("text"))}
    loss = {TEXT: F.col("role").isin(*template.trained)}
    parts = [F.struct(values.get(s, F.lit(s)).alias("text"), loss.get(s, F.lit(False)).alias("loss")) for s in template.segments]
    return seen.select("conv_id", "nth", legal.alias("legal"), F.array(*parts).alias("segments"))


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("legal", pa.bool_())])


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, trained = re.compile(template.pattern, re.S), set(template.trained)

        def told(conv, rows) -> tuple:
            turns, loss, whole, n, legal = Digest(), Digest(), Digest(), 0, True
            for _, _, ok, segments in rows:
                line = "".join(s["text"] for s in segments)
                whole.add(line)
                m = turn.fullmatch(line)
                if m is None:
                    raise ValueError("a formatted turn can't be read back")
                role, masked = unescape_role(m["role"]), [s["text"] for s in segments if s["loss"]]
                if masked != ([m["text"]] if role in trained else []):
                    raise ValueError("the loss mask isn't the text of a trained role")
                turns.add(role, "\n", unescape(m["text"]), "\n")
                loss.add(*map(unescape, masked))
                n, legal = n + 1, legal and ok
            return conv, n, turns.hex, loss.chars, loss.hex, whole.chars, legal

        return batches_of((told(k, rows) for k, rows in conversations(batches)), READ)

    return run


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the formatted turns say, one row a conversation: turns and text under the loss mask, unescaped."""
    rows = streamed(formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "nth", "legal", "segments"), "conv_id", F.col("nth"))
    return rows.mapInArrow(_read(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean")
