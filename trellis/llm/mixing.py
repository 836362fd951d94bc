"""Mixing sources to target weights (operator 6).

Tokens are summed by source, targets are found by filling weighted shares up to a cap,
and each document is emitted floor(rate) times plus one copy drawn with probability equal
to the fraction of its rate, by a hash of a seed, its id and its text.

Defined cases: a null text has no words and is drawn like an empty one; a null id counts as
an empty text in the draw; a null source is a source of its own, the last; sources of no words
are never taken; rows that repeat in id and text share their draw; an empty table gives none.
Other columns may have any name. Texts are only counted and hashed, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

SEED = "mix-1"


def size_of(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, id_col: Column, text: Column) -> Column:
    """A number in [0, 1), the same in every run: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources in order of code points, null last, take the weights in turn. All targets sum
    to all sizes; a target stops at cap times its source's size, and what is above is
    shared again by weight. That is a common level times the weight: over the sources in
    order of the level that fills them, the level left for the rest rises while sources
    are full and falls after, so the largest one is it. The windows run over one row a
    source. Sources of no words have the target 0; an empty table gives none.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = one.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    full = F.col("source_size") * F.lit(float(cap))
    rise = Window.orderBy(F.col("fills"), F.col("source").asc_nulls_last())
    before, whole = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("most", full).withColumn("fills", F.col("most") / F.col("weight")).withColumn("level", level)
    return levels.select("source", "source_size", "weight", F.least(F.col("most"), F.max("level").over(whole) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row a row of docs: (id, draw, size, source, source_size, target, copies).

    Rows with equal id and text get equal draws. A null source is a source of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), draw(seed, F.col(id_col), F.col(text_col)).alias("draw"))
    sized = Scratch(rows, "sizes").read()
    t = targets(sized, weights, cap).select(F.col("source").alias("t_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("id", "draw", "size", "source", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """docs with each row repeated as its source's rate says; the columns stay.

    The rates, one row a source, are found first; then each row decides by itself, so
    texts aren't shuffled on any key but the source, and not at all while Spark finds the
    rates small enough to broadcast.
    """
    sized = Scratch(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes").read()
    t = Scratch(targets(sized, weights, cap), "targets").read().select(F.col("source").alias("of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    rate = F.col("rate")
    # a row travels as one struct, so that no column of docs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), draw(seed, F.col(id_col), F.col(text_col)).alias("draw"))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    taken = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).select("row", copies.cast("int").alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
