"""Full-text search over symbols: BM25 on display names and comments."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..functions import tokens
from .fulltext import PART_BITS, Node, counted, idf, judge, parse, phrases_of, weight, words_in
from .scope import with_scope

if TYPE_CHECKING:
    from ..sources.textindex import TextIndex


def _spots(parts: list[str], word: tuple[str, bool]) -> Column:
    """Where a word stands in columns of tokens."""
    text, prefix = word
    hit = (lambda t: F.startswith(t, F.lit(text))) if prefix else (lambda t: t == text)

    def of(k: int, c: str) -> Column:
        at = F.transform(F.col(c), lambda t, i: F.when(hit(t), i.cast("long") + (k << PART_BITS)).otherwise(F.lit(-1).cast("long")))
        return F.when(F.exists(F.col(c), hit), F.filter(at, lambda s: s >= 0)).otherwise(F.array().cast("array<bigint>"))

    found = [of(k, c) for k, c in enumerate(parts)]
    return F.concat(*found) if len(found) > 1 else found[0]


def scored(rows: DataFrame, tree: Node, n: Column, mean: Column, dfs: list[Column]) -> DataFrame:
    """(id, score) of the rows (id, length, near0, near1, ...) that an expression matches."""
    near = [F.col(f"near{k}") for k in range(len(dfs))]
    match, score = judge(tree, [c > 0 for c in near], [weight(idf(n, d), c, F.col("length"), mean) for c, d in zip(near, dfs, strict=True)])
    return rows.filter(match).select("id", score.alias("score"))


def bm25(df: DataFrame, id_col: str, columns: tuple[str, ...], query: str) -> DataFrame:
    """(id, score) of the rows that match a full-text expression (see `fulltext`), higher is better.

    The weights count every row of df, its empty ones too. A row is judged by itself; the counts
    of the corpus, one row, come from a second reading, and nothing else is shuffled.
    """
    tree = parse(query, columns)
    names = [f"t{k}" for k in range(len(columns))]
    cut = df.select(F.col(id_col).alias("id"), *[tokens(c).alias(t) for c, t in zip(columns, names, strict=True)])
    if tree is None:
        return cut.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    rows = counted(cut.select("id", sum((F.size(t) for t in names), F.lit(0)).alias("length"), *[_spots(names, w).alias(f"w{k}") for k, w in enumerate(words_in(tree))]), tree)
    phrases = range(len(phrases_of(tree)))
    total = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"own{k}") > 0).alias(f"df{k}") for k in phrases])
    # total is one row
    return scored(rows.join(F.broadcast(total)), tree, F.col("n"), F.col("mean"), [F.col(f"df{k}") for k in phrases])


def match_terms(df: DataFrame, id_col: str, columns: tuple[str, ...], query: str, top: int, where=None) -> DataFrame:
    """(id, score) of the best rows; where is a condition on df that ranks are filtered by before the cut."""
    found = bm25(df, id_col, columns, query)
    if where is not None:
        found = found.join(df.filter(where).select(F.col(id_col).alias("id")), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(top)


#: The columns of symbols that are searched.
SEARCHED = ("display_name", "doc_comment")


def semantic_search(ix: Index, query: str, kind: str | None = None, max_results: int = 20, scope: str | None = None, strict_topk: bool = False, text: TextIndex | None = None) -> DataFrame:
    """Symbols by relevance. A scope filters what the cut leaves; with strict_topk it comes before.

    text: a stored index of the symbols' SEARCHED columns, which is read in place of the symbols'.
    """
    top = max(0, min(max_results, ix.config.fts_max))
    symbols = ix.symbols
    where = None if kind is None else F.lower("kind") == kind.lower()
    every = lambda: bm25(symbols, "id", SEARCHED, query) if text is None else text.matches(query)
    if strict_topk:
        inside = with_scope(ix, symbols if where is None else symbols.filter(where), scope)
        return inside.join(every(), "id").orderBy(F.desc("score"), "id").limit(top)
    if text is not None and where is None:
        found = text.search(query, top)
    else:
        found = every() if where is None else every().join(symbols.filter(where).select("id"), "id", "left_semi")
        found = found.orderBy(F.desc("score"), "id").limit(top)
    return with_scope(ix, symbols.join(F.broadcast(found), "id"), scope)
