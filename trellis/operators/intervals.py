"""Points in intervals, without meeting all points of a file with all of its intervals.

An interval of lines is cut into dyadic nodes, whole blocks of 2^level lines: at most two a
level, and a point lies in exactly one node of an interval that holds it. So points and
intervals meet by equality on (file, level, node). The work is in proportion to the rows times
the levels, whatever their overlap, and a hot file or node is a hot key of a grouping or a join.

Defined cases: an interval with a null end, or that ends before it begins, holds nothing; a
point with a null line lies in none; lines may be negative; equal rows are one point or interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nodes: lines are 32-bit.
LEVELS = 32


def nodes(start: str, end: str) -> Column:
    """array<struct<level, at>>: the nodes of an interval, both ends included."""
    first, after = f"shiftright(cast({start} as bigint) + shiftleft(1L, k) - 1, k)", f"shiftright(cast({end} as bigint) + 1, k)"
    left = f"if({first} < {after} and {first} & 1 = 1, struct(k as level, {first} as at), null)"
    right = f"if({first} < {after} and {after} & 1 = 1, struct(k as level, {after} - 1 as at), null)"
    return F.expr(f"filter(flatten(transform(sequence(0, {LEVELS}), k -> array({left}, {right}))), x -> x is not null)")


def _cut(intervals: DataFrame, on: list[str], start: str, end: str, *more: Column) -> DataFrame:
    return intervals.filter(F.col(start) <= F.col(end)).select(*on, *more, F.explode(nodes(start, end)).alias("n")).select("*", "n.*").drop("n")


def _levels(cut: DataFrame, on: list[str]) -> DataFrame:
    """The levels that a file's nodes have, at most LEVELS + 1: points need no others."""
    return cut.groupBy(*on).agg(F.collect_set("level").alias("levels"))


def _points(points: DataFrame, levels: DataFrame, on: list[str], line: str) -> DataFrame:
    at = points.join(levels, on).select(*points.columns, F.explode("levels").alias("level"))
    return at.withColumn("at", F.expr(f"shiftright(cast({line} as bigint), level)"))


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], line: str = "line", start: str = "line_start", end: str = "line_end", id_col: str = "id") -> DataFrame:
    """(on..., line, id) of points with the interval around them that begins last, of those the lowest id; points in none have no row.

    Of the intervals that share a node all hold the whole node, so only the best one stays.
    """
    begins = F.struct(F.col(start).alias("start"), (-F.col(id_col)).alias("less")).alias("best")
    cut = _cut(intervals, on, start, end, begins).groupBy(*on, "level", "at").agg(F.max("best").alias("best"))
    found = _points(points.select(*on, line).distinct(), _levels(cut, on), on, line).join(cut, [*on, "level", "at"])
    return found.groupBy(*on, line).agg(F.max("best").alias("best")).select(*on, line, (-F.col("best.less")).alias(id_col))


def counts_inside(intervals: DataFrame, points: DataFrame, on: list[str], line: str = "line", start: str = "line_start", end: str = "line_end", id_col: str = "id") -> DataFrame:
    """(id, count) of intervals that hold points: points are counted by node first, so no pairs are made."""
    cut = _cut(intervals, on, start, end, F.col(id_col))
    per_node = _points(points.select(*on, line), _levels(cut, on), on, line).groupBy(*on, "level", "at").agg(F.count("*").alias("n"))
    return cut.join(per_node, [*on, "level", "at"]).groupBy(id_col).agg(F.sum("n").alias("count"))
