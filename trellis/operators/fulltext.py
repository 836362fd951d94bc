"""Full-text expressions: their grammar, and what they find and weigh in a row.

    phrase  := string [*] [+ phrase]            the words of a string in consecutive places; * a prefix
    group   := [^] phrase | NEAR(phrase phrase ... [, n])
    set     := [[-] column | {column ...} :] group
    expr    := set set ... | expr AND expr | expr OR expr | expr NOT expr | [set-columns :] (expr)

Neighbours without an operator bind first, then NOT, AND, OR. A string is a word of letters,
digits, _ and characters beyond ASCII, or anything in double quotes. Strings without words are
left out. An expression becomes a small tree on the driver; rows are judged by built-in column
functions over the sorted places ("spots") of its words, so no row is ever exploded.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold_text

K1, B, LEAST_IDF, NEAR = 1.2, 0.75, 1e-6, 10
#: A spot is the number of a column, shifted, plus the place of a word in it.
PART_BITS = 32


@dataclass(frozen=True)
class Phrase:
    """Words with whether each is a prefix; first: only at the start of a column; columns: None for all."""

    words: tuple[tuple[str, bool], ...]
    first: bool = False
    columns: frozenset[int] | None = None


@dataclass
class Node:
    """kind: near (phrases within distance), and, or, not (the first child but not the second)."""

    kind: str
    children: list[Node] = field(default_factory=list)
    phrases: list[Phrase] = field(default_factory=list)
    distance: int = NEAR


class Syntax(ValueError):
    pass


TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-]))')


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.tokens, self.at, self.columns, end = [], 0, [c.lower() for c in columns], 0
        text = text.rstrip()
        while end < len(text):
            m = TOKEN.match(text, end)
            if m is None:
                raise Syntax(text[end:])
            quoted, bare, mark = m.groups()
            kind = "string" if quoted is not None else "op" if bare in ("AND", "OR", "NOT") else "string" if bare else mark
            self.tokens.append((kind, quoted.replace('""', '"') if quoted is not None else bare or mark, quoted is not None))
            end = m.end()

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else ""

    def op(self) -> str:
        return self.tokens[self.at][1] if self.peek() == "op" else ""

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise Syntax(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node | None:
        tree = self.binary(("OR", "AND", "NOT"))
        if self.at < len(self.tokens):
            raise Syntax("more than an expression")
        return tree

    def binary(self, ops: tuple[str, ...]) -> Node | None:
        """Operators of one rank from the left, operands of the next rank."""
        if not ops:
            return self.operand()
        left = self.binary(ops[1:])
        while self.op() == ops[0]:
            self.at += 1
            right = self.binary(ops[1:])
            if ops[0] == "NOT":
                left = left if right is None or left is None else Node("not", [left, right])
            else:
                left = joined(ops[0].lower(), [left, right])
        return left

    def operand(self) -> Node | None:
        if self.peek() == "(":
            return self.inside()
        columns, held = self.column_set(), []
        if columns is not None and self.peek() == "(":
            return limited(self.inside(), columns)
        while True:
            group = self.group()
            held.append(group if columns is None else limited(group, columns))
            mark = self.at
            columns = self.column_set()
            if self.peek() not in ("string", "^"):
                if self.at != mark or self.peek() == "(":
                    raise Syntax("a group expected")
                return joined("and", held)

    def inside(self) -> Node | None:
        self.take("(")
        tree = self.binary(("OR", "AND", "NOT"))
        self.take(")")
        return tree

    def column_set(self) -> frozenset[int] | None:
        start, without = self.at, self.peek() == "-"
        self.at += without
        names = []
        if self.peek() == "{":
            self.at += 1
            while self.peek() == "string":
                names.append(self.take("string"))
            self.take("}")
        elif self.peek() == "string" and self.peek(1) == ":":
            names.append(self.take("string"))
        elif without:
            raise Syntax("columns expected")
        else:
            self.at = start
            return None
        self.take(":")
        if not names or any(n.lower() not in self.columns for n in names):
            raise Syntax("no such column")
        found = {self.columns.index(n.lower()) for n in names}
        return frozenset(set(range(len(self.columns))) - found if without else found)

    def group(self) -> Node | None:
        if self.peek() == "string" and self.peek(1) == "(":
            if self.tokens[self.at][1] != "NEAR" or self.tokens[self.at][2]:
                raise Syntax("NEAR expected")
            self.at += 2
            phrases, distance = [self.phrase()], NEAR
            while self.peek() == "string":
                phrases.append(self.phrase())
            if self.peek() == ",":
                self.at += 1
                number = self.take("string")
                if not number.isascii() or not number.isdigit():
                    raise Syntax("a number expected")
                distance = int(number)
            self.take(")")
            phrases = [p for p in phrases if p.words]
            return Node("near", phrases=phrases, distance=distance) if phrases else None
        first = self.peek() == "^"
        self.at += first
        p = self.phrase()
        return Node("near", phrases=[Phrase(p.words, first)]) if p.words else None

    def phrase(self) -> Phrase:
        words: list[tuple[str, bool]] = []
        while True:
            words += [(w, False) for w in words_of(self.take("string"))]
            if self.peek() == "*":
                self.at += 1
                words[-1:] = [(w, True) for w, _ in words[-1:]]
            if self.peek() != "+":
                return Phrase(tuple(words))
            self.at += 1


def joined(kind: str, nodes: list[Node | None]) -> Node | None:
    held = [n for n in nodes if n is not None]
    return held[0] if len(held) == 1 else Node(kind, held) if held else None


def limited(tree: Node | None, columns: frozenset[int]) -> Node | None:
    """tree with its phrases in these columns only."""
    if tree is None:
        return None
    cut = [Phrase(p.words, p.first, columns if p.columns is None else p.columns & columns) for p in tree.phrases]
    return Node(tree.kind, [limited(c, columns) for c in tree.children], cut, tree.distance)


def parse(text: str | None, columns: tuple[str, ...] = ()) -> Node | None:
    """The tree of an expression, None if it holds no words. What breaks the grammar counts as the words that it holds."""
    try:
        return _Parser(text or "", columns).whole()
    except Syntax:
        return joined("and", [Node("near", phrases=[Phrase(((w, False),))]) for w in words_of(text or "")])


def phrases_of(tree: Node) -> list[Phrase]:
    """Phrases in order of place; one that stands twice counts twice."""
    return tree.phrases + [p for c in tree.children for p in phrases_of(c)]


def words_in(tree: Node) -> list[tuple[str, bool]]:
    return sorted({w for p in phrases_of(tree) for w in p.words})


def plain_words(tree: Node) -> bool:
    """Whether all phrases are single whole words, anywhere."""
    return all(len(p.words) == 1 and not p.words[0][1] and not p.first and p.columns is None for p in phrases_of(tree)) and _single(tree)


def _single(tree: Node) -> bool:
    return len(tree.phrases) < 2 and all(_single(c) for c in tree.children)


def phrase_spots(p: Phrase, spots: Callable[[tuple[str, bool]], Column]) -> Column:
    """Sorted spots where a phrase starts."""
    back = lambda at, k: F.transform(at, lambda s: s - F.lit(k).cast("long"))
    at = spots(p.words[0])
    for k, w in enumerate(p.words[1:], 1):
        at = F.array_intersect(at, back(spots(w), k))
    if p.columns is not None:
        at = F.filter(at, lambda s: F.shiftright(s, PART_BITS).isin(*sorted(p.columns))) if p.columns else F.array().cast("array<bigint>")
    if p.first:
        at = F.filter(at, lambda s: s.bitwiseAND(F.lit((1 << PART_BITS) - 1)) == 0)
    return at


def _within(s: Column, end: Column, room: int) -> Column:
    return (s <= end) & (s >= end - F.lit(room).cast("long"))


def _ends(at: list[Column], rooms: list[int]) -> Column:
    """Spots of phrases at which a near group ends: each phrase starts there or no more than its room before."""
    ending = lambda ends, spots, room: F.filter(ends, lambda e: F.exists(spots, lambda s: _within(s, e, room)))
    return reduce(lambda ends, x: ending(ends, *x), zip(at, rooms, strict=True), F.array_distinct(F.concat(*at)))


def _held(rows: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """rows with more columns, behind a generator: else the optimiser would work them out anew inside lambdas."""
    return rows.select(*keep, F.inline(F.array(F.struct(*made))))


def counted(rows: DataFrame, tree: Node) -> DataFrame:
    """(id, length, own0, near0, ...): how often each phrase stands in a row, by itself and with its group near.

    rows: (id, length, w0, w1, ...), the sorted spots of words_in(tree).
    """
    words, phrases, fixed = words_in(tree), phrases_of(tree), ["id", "length"]
    names = [f"p{k}" for k in range(len(phrases))]
    at = [phrase_spots(p, lambda w: F.col(f"w{words.index(w)}")).alias(n) for p, n in zip(phrases, names, strict=True)]
    groups = [(k, g) for k, g in _groups(tree) if len(g.phrases) > 1]
    near = {n: F.size(n) for n in names}
    if groups:
        rows = _held(rows, fixed, at)
        rooms = {k: [len(p.words) + g.distance for p in g.phrases] for k, g in groups}
        rows = _held(rows, fixed + names, [_ends([F.col(n) for n in names[k : k + len(rooms[k])]], rooms[k]).alias(f"e{k}") for k, _ in groups])
        near |= {n: _near(n, f"e{k}", room) for k, _ in groups for n, room in zip(names[k:], rooms[k])}
    else:
        rows = rows.select(*fixed, *at)
    return rows.select(*fixed, *[c for k, n in enumerate(names) for c in (F.size(n).alias(f"own{k}"), near[n].alias(f"near{k}"))])


def _near(spots: str, ends: str, room: int) -> Column:
    return F.size(F.filter(F.col(spots), lambda s: F.exists(F.col(ends), lambda e: _within(s, e, room))))


def _groups(tree: Node, at: int = 0) -> list[tuple[int, Node]]:
    """Groups of phrases with the number of their first one."""
    out = [(at, tree)] if tree.phrases else []
    for c in tree.children:
        out += _groups(c, at)
        at += len(phrases_of(c))
    return out


def judge(tree: Node, present: list[Column], weights: list[Column]) -> tuple[Column, Column]:
    """(whether a row matches, its score): a phrase counts where the parts of the tree that hold it match."""

    def walk(node: Node, at: int) -> tuple[Column, Column, int]:
        if node.phrases:
            end = at + len(node.phrases)
            return reduce(lambda a, b: a & b, present[at:end]), reduce(lambda a, b: a + b, weights[at:end]), end
        parts = []
        for c in node.children:
            match, score, at = walk(c, at)
            parts.append((match, F.when(match, score).otherwise(F.lit(0.0))))
        if node.kind == "not":
            return parts[0][0] & ~parts[1][0], parts[0][1], at
        both = (lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b)
        return reduce(both, [m for m, _ in parts]), reduce(lambda a, b: a + b, [s for _, s in parts]), at

    match, score, _ = walk(tree, 0)
    return match, score


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def weight(idf_: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
