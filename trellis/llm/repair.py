"""Conversation structure repair (operator 12).

The cheapest edits that give a conversation's roles the shape `(s?(ua)+)?`: rows may be kept,
given another role or deleted, and empty turns inserted. Blank rows and repeats have to go.
A backward pass over the turns finds, for each place and each state of the grammar, the cost to
go; a forward walk then takes, among the edits that cost no more than the cost to go says,
the one whose initial comes first in ASCII. An audit (one letter an edit) decides the repair:
inserted and rerouted turns take the only role that the state allows.

Rows that are equal in turn, role and text become one row with a number of copies before
anything is shuffled by conversation, and the passes over turns hold no texts: a row is a
number, a run of repeats is one number, and the costs are four numbers a row. What one
conversation needs in a task is thus in proportion to its audit, which is a cell of the result;
texts only stream by, one at a time.

Defined cases: a null in any column is one space (for the crc: in the id and the turn, for
rows: in role and text; a null turn comes first); a role with no letters has no initial and can't
be kept; rows of one turn are in order of role, then MD5 of the text; other columns aren't
read; an empty table gives none; a conversation without rows left gives an empty audit.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .turns import Digest, batches_of, conversations, streamed

KEEP, DELETE, INSERT, REROLE, CUT = 0, 3, 2, 2, 1
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept role's initial leads to, by (state, initial).
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that a made turn leads to: the only role the state allows.
MADE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
FAR = 1 << 60


def damage(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of `id:turn`, modulo 20; copies is 0 for dropped rows."""
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank))) % 20
    text = F.coalesce(F.col(text_col), blank)
    return rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(k == 4, F.lit("user")).otherwise(F.coalesce(F.col(role_col), blank)).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text, copies, blank, cut, first): one row for equal rows, faults found.

    first: no row of an earlier turn has its role and text. Repeats in other turns are found by
    a grouped minimum and met by an equi-join, both of which split a frequent text.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    one = one.select("*", F.md5("text").alias("digest"))
    there = one.filter("copies > 0").groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min(order).alias("begins"), F.count("*").alias("times")).filter("times > 1")
    later = one.join(there, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
    return later.select(
        "conv_id", "turn", "role", "digest", "text", "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        (F.col("begins").isNull() | (order == F.col("begins"))).alias("first"),
    )


def cost_to_go(steps: array, initials: str) -> list[array]:
    """For each place and state the cost of the cheapest edits from there; steps as in `audited`."""
    n = len(steps)
    costs = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    after = [0, INSERT * 2, INSERT, 0]
    for g in range(4):
        costs[g][n] = after[g]
    for i in range(n - 1, -1, -1):
        step = steps[i]
        if step < 0:
            after = [c - step * DELETE for c in after]
        else:
            cut, first = step & 1, initials[step >> 1]
            base = []
            for g in range(4):
                to = MOVES.get((g, first))
                keep = FAR if to is None else KEEP + cut * CUT + after[to]
                base.append(min(DELETE + after[g], keep, REROLE + cut * CUT + after[MADE[g]]))
            user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
            after = [min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant]
        for g in range(4):
            costs[g][i] = after[g]
    return costs


def walk(steps: array, initials: str, costs: list[array]) -> str:
    """The ASCII-least of the cheapest audits: the first edit, in order D, I, K, R, that the costs to go bear out."""
    out, g = [], START
    for i, step in enumerate(steps):
        if step < 0:
            out.append("D" * -step)
            continue
        cut, first = step & 1, initials[step >> 1]
        while True:
            left, to = costs[g][i], MOVES.get((g, first))
            if left == DELETE + costs[g][i + 1]:
                out.append("D")
                break
            if left == INSERT + costs[MADE[g]][i]:
                out.append("I")
                g = MADE[g]
                continue
            if to is not None and left == KEEP + cut * CUT + costs[to][i + 1]:
                out.append("K")
                g = to
            else:
                out.append("R")
                g = MADE[g]
            break
    while costs[g][len(steps)] > 0:
        out.append("I")
        g = MADE[g]
    return "".join(out)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT_ROWS = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
LIGHT = ("conv_id", "turn", "initial", "copies", "blank", "cut", "first")


def audited(conv, rows: Iterator[tuple]) -> tuple:
    """One conversation's report. A step is a row that may stay (twice its initial's place, plus 1 if cut) or minus a number of rows that have to go."""
    steps, initials, places = array("q"), "", {}
    blank = duplicate = truncated = illegal = turns = 0
    low = high = before = last = None
    for _, turn, initial, copies, is_blank, cut, first in rows:
        if not copies:
            continue
        if turn is not None:
            low, high = turn if low is None else low, turn
            turns, last = turns + (turn != last), turn
        illegal += copies - 1 + (before is not None and before + initial not in LEGAL_PAIRS)
        before, gone = initial, copies
        if is_blank:
            blank += copies
        else:
            gone -= first
            duplicate += gone
            if first:
                truncated += cut
                if initial not in places:
                    places[initial] = len(initials)
                    initials += initial or "\0"
                steps.append(2 * places[initial] + cut)
        if gone:
            steps.append(-gone)
    costs = cost_to_go(steps, initials)
    gaps = 0 if low is None else high - low + 1 - turns
    return conv, gaps, blank, duplicate, truncated, illegal, costs[START][0], walk(steps, initials, costs)


def reports(rows: DataFrame) -> DataFrame:
    """REPORT for each conversation of prepared rows; no texts are shuffled."""
    light = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "cut", "first", "role", "digest")
    run = lambda batches: batches_of((audited(k, r) for k, r in conversations(b.select(list(LIGHT)) for b in batches)), REPORT_ROWS)
    return streamed(light, "conv_id", F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")).mapInArrow(run, REPORT)


TURNS = "conv_id long, nth long, role string, text string, edit string"
TURN_ROWS = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def rebuilt(conv, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired turns of one conversation: its audit comes first, then its rows."""
    audit, k, g, nth = next(rows)[1], 0, START, 0
    for _, _, role, text, copies in rows:
        for _ in range(copies):
            while audit[k] == "I":
                g, k, nth = MADE[g], k + 1, nth + 1
                yield conv, nth, NAMES[g], "", "I"
            edit, k = audit[k], k + 1
            if edit != "D":
                g, nth = (MOVES[g, role[0]], nth + 1) if edit == "K" else (MADE[g], nth + 1)
                yield conv, nth, role if edit == "K" else NAMES[g], text, edit
    for _ in audit[k:]:
        g, nth = MADE[g], nth + 1
        yield conv, nth, NAMES[g], "", "I"


def turns(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text, edit): the repaired turns of prepared rows and their reports, edits K, R and I."""
    long = F.col("conv_id").cast("long").alias("conv_id")
    none = F.lit(None).cast("string")
    both = told.select(long, "audit", none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("turn"), none.alias("digest"), F.lit(0).alias("kind"))
    both = both.unionByName(rows.select(long, none.alias("audit"), "role", "text", "copies", F.col("turn").cast("long").alias("turn"), "digest", F.lit(1).alias("kind")))
    run = lambda batches: batches_of((t for k, r in conversations(b.select(["conv_id", "audit", "role", "text", "copies"]) for b in batches) for t in rebuilt(k, r)), TURN_ROWS)
    return streamed(both, "conv_id", F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")).mapInArrow(run, TURNS)


def hashes(repaired: DataFrame) -> DataFrame:
    """(h_conv_id, repaired_sha256) of `role:text`, joined by line ends, one conversation after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(conv, rows) -> tuple:
            d = Digest()
            for k, (_, role, text) in enumerate(rows):
                d.add("\n" if k else "", role, ":", text)
            return conv, d.hex

        schema = pa.schema([("h_conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        return batches_of((told(k, r) for k, r in conversations(b.select(["conv_id", "role", "text"]) for b in batches)), schema)

    return streamed(repaired.select("conv_id", "role", "text", "nth"), "conv_id", F.col("nth")).mapInArrow(run, "h_conv_id long, repaired_sha256 string")


def with_hashes(told: DataFrame, repaired: DataFrame) -> DataFrame:
    """Reports with the hash of their repaired turns; of none the hash of an empty text."""
    both = told.join(hashes(repaired), F.col("conv_id").eqNullSafe(F.col("h_conv_id")), "left").drop("h_conv_id")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
