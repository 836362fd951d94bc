"""Source lines next to what was found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_LINES = 3


def lines_of(text: Column) -> Column:
    """Lines of a text; its last line end begins no line, and an empty text has none."""
    body = F.regexp_replace(text, r"(?:\r\n|\r|\n)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))


def _with_lines(rows: DataFrame, files: DataFrame, path: str, first: Column, last: Column, start: Column | None, end: Column | None) -> DataFrame:
    """rows with source_context: the lines first to last of their file, as far as it has them; null for a file that isn't known.

    Only the files that rows name are read; a text is cut into lines once, before the join.
    """
    known = files.select(F.col("file_path").alias("__path"), F.col("text").alias("__text"))
    wanted = rows.select(F.col(path).alias("__path")).distinct()
    cut = known.join(wanted, "__path", "left_semi").select("__path", lines_of(F.col("__text")).alias("__lines"))
    a = F.greatest(first, F.lit(1)).cast("int")
    b = F.least(last, F.size("__lines")).cast("int")
    held = F.when(b >= a, F.slice("__lines", a, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    lines = F.transform(held, lambda x, i: F.struct((a + i).alias("line_number"), x.alias("content")))
    context = F.struct((a if start is None else start).alias("start_line"), (b if end is None else end).alias("end_line"), lines.alias("lines"))
    out = rows.join(cut, F.col(path) == F.col("__path"), "left")
    return out.withColumn("source_context", F.when(F.col("__lines").isNotNull(), context)).drop("__path", "__lines")


def with_declaration(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (file_path, line_start, line_end) with the lines of their declaration; files: (file_path, text)."""
    first, last = F.col("line_start"), F.col("line_end")
    return _with_lines(rows, files, "file_path", first, last, first, last)


def with_context(rows: DataFrame, files: DataFrame, path: str = "file_path", line: str = "line", context_lines: int = CONTEXT_LINES) -> DataFrame:
    """rows with the lines around a line of a file; files: (file_path, text)."""
    return _with_lines(rows, files, path, F.col(line) - context_lines, F.col(line) + context_lines, None, None)
