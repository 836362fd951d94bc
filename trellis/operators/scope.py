"""Scopes: file:PATH, project:ID, solution:PATH or all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index


def with_scope(ix: Index, df: DataFrame, scope: str | None, file_col: str = "file_path", project_col: str = "project_id") -> DataFrame:
    """Rows of df in a scope. A scope that names nothing known, and an unknown kind, filter nothing."""
    kind, _, value = (scope or "all").partition(":")
    if kind == "file":
        return df.filter(F.col(file_col) == value)
    if kind == "project":
        found = ix.projects.filter(F.col("canonical_id") == value).select("id").head()
        return df if found is None else df.filter(F.col(project_col) == found.id)
    if kind == "solution":
        found = ix.solutions.filter(F.col("file_path") == value).select("id").head()
        if found is None:
            return df
        inside = ix.solution_projects.filter(F.col("solution_id") == found.id).select(F.col("project_id").alias("__scope"))
        return df.join(inside, F.col(project_col) == F.col("__scope"), "left_semi")
    return df


def project_named(ix: Index, canonical_id: str) -> int | None:
    found = ix.projects.filter(F.col("canonical_id") == canonical_id).select("id").head()
    return None if found is None else found.id


def in_project(ix: Index, df: DataFrame, canonical_id: str | None, column: str = "project_id") -> DataFrame:
    """Rows of one project; an unknown one has none; None keeps all."""
    if canonical_id is None:
        return df
    return df.filter(F.col(column) == F.lit(project_named(ix, canonical_id)))


def project_names(ix: Index, df: DataFrame, column: str = "project_id", out: str = "project") -> DataFrame:
    """df with the canonical id of a project, or its number as text where there's none."""
    names = ix.projects.select(F.col("id").alias("__project"), "canonical_id")
    joined = df.join(names, F.col(column) == F.col("__project"), "left")
    return joined.withColumn(out, F.coalesce("canonical_id", F.col(column).cast("string"))).drop("__project", "canonical_id")
