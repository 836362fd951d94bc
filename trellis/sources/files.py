"""Source files as tables: hashes, tagged comments, project files and submodules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import comment_tag, comment_text, is_generated, is_ignored, target_framework


def content_hashes(spark: SparkSession, path: str, pattern: str = "*.cs") -> DataFrame:
    """(file_path, content_hash) of the files under a path; build folders and generated files don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.filter(~is_ignored("path") & ~is_generated("path")).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"))


_HOLE = r"""\{(?:[^{}"']++|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)++')*+\}"""
#: What a source text is made of, read from the left: strings (raw, interpolated and verbatim, interpolated, verbatim, plain),
#: characters, comments, and runs without any of them. What isn't closed goes on to the end, so no text is read twice.
SOURCE_PARTS = rf"""(?s)(\$*+("{{3,}}+).*?(?:\2"*+|\z)|(?:\$@|@\$)"(?:[^"{{]++|""|\{{\{{|{_HOLE}|\{{)*+(?:"|\z)|\$"(?:[^"{{\\\n]++|\\.|\{{\{{|{_HOLE}|\{{)*+"|@"(?:[^"]++|"")*+(?:"|\z)|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)++'|//[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|[^"'/@$]++|.)"""


def extract_comments(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """(file_path, line, tag, text) of tagged // and /* */ comments, by the line on which they begin.

    A text is cut into its parts once, from the left, so what stands in a string is no comment,
    its holes and raw strings included (a hole with braces of its own ends the string's part early).
    Line ends are summed over the parts by a window of one text, which keeps only parts with line
    ends and comments. A null text has none.
    """
    parts = F.regexp_extract_all(F.col(text_col), F.lit(SOURCE_PARTS), 1)
    rows = files.select(F.col(path_col).alias("file_path"), F.monotonically_increasing_id().alias("file"), parts.alias("parts")).select("file_path", "file", F.posexplode("parts").alias("pos", "part"))
    comment = F.startswith("part", F.lit("//")) | (F.startswith("part", F.lit("/*")))
    rows = rows.select("file_path", "file", "pos", (F.length("part") - F.length(F.replace("part", F.lit("\n"), F.lit("")))).alias("ends"), F.when(comment, F.col("part")).alias("c")).filter("ends > 0 or c is not null")
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    every = rows.withColumn("line", (F.coalesce(F.sum("ends").over(before), F.lit(0)) + 1).cast("int")).filter("c is not null").withColumn("tag", comment_tag("c"))
    return every.filter(F.col("tag") != "").select("file_path", "line", "tag", comment_text("c").alias("text"))


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """(disk_path, target_framework) of the project files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csproj").option("recursiveFileLookup", "true").load(path)
    xml = F.regexp_replace(F.decode("content", "UTF-8"), r"^﻿|xmlns=\"[^\"]*\"", "")
    return files.filter(~is_ignored("path")).select(F.col("path").alias("disk_path"), target_framework(xml).alias("target_framework"))


def submodules(status: DataFrame, column: str = "line") -> DataFrame:
    """(path, commit) from the lines of a submodule status report; other lines give none."""
    form = r"^[ +\-U]?([0-9a-f]{7,64})\s+(\S.*?)(?:\s+\(.*\))?\s*$"
    rows = status.select(F.regexp_extract(column, form, 2).alias("path"), F.regexp_extract(column, form, 1).alias("commit"))
    return rows.filter("commit <> ''")


def assign_submodules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files with the submodule (path) that holds them, whatever the case of letters; the first in order if several do.

    Each file is exploded to the folders above it, which are joined by equality.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    parts = F.split(norm(F.col("file_path")), "/")
    above = files.select("file_path").distinct().select("file_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts")).select("file_path", F.array_join(F.expr("slice(parts, 1, k)"), "/").alias("folder"))
    named = modules.select(F.col("path").alias("submodule"), F.regexp_replace(norm(F.col("path")), "/$", "").alias("folder"))
    best = above.join(named, "folder").groupBy("file_path").agg(F.min("submodule").alias("submodule"))
    return files.join(best, "file_path", "left")
