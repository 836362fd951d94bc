"""What projects depend on, and which of them are test projects, from their references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import package_of_path
from .files import assign_submodules

#: Names that mark a reference to a test framework, in any case of letters.
TEST_PACKAGES = ("Microsoft.NET.Test.Sdk", "xunit", "xunit.core", "NUnit", "nunit", "MSTest.TestFramework")


def mark_test_projects(projects: DataFrame, references: DataFrame) -> DataFrame:
    """projects with is_test_project: whether any of their references (project_id, reference) names a test framework."""
    name = F.lower("reference")
    names = sorted({p.lower() for p in TEST_PACKAGES})
    hit = references.filter(reduce(lambda a, b: a | b, [name.contains(p) for p in names]))
    tests = hit.select(F.col("project_id").alias("__test")).distinct()
    marked = projects.join(tests, F.col("id") == F.col("__test"), "left")
    return marked.withColumn("is_test_project", F.col("__test").isNotNull()).drop("__test")


def classify_dependencies(projects: DataFrame, project_references: DataFrame, modules: DataFrame, references: DataFrame) -> DataFrame:
    """(consumer_project_id, dependency_project_id, reference_kind, submodule_pinned_commit) of all projects.

    projects: (id, file_path); project_references: (project_id, file_path), of which unknown
    paths give none; modules: (path, commit); references: (project_id, reference), of which
    those under a packages folder are of kind nuget_ref, with dependency 0 and the package's name.
    """
    known = projects.select(F.col("id").alias("dependency_project_id"), "file_path")
    direct = project_references.select(F.col("project_id").alias("consumer_project_id"), "file_path").join(known, "file_path")
    direct = direct.join(projects.select(F.col("id").alias("consumer_project_id")), "consumer_project_id", "left_semi")
    held = assign_submodules(direct, modules).join(modules.select(F.col("path").alias("submodule"), "commit"), "submodule", "left")
    kind = F.when(F.col("submodule").isNull(), "project_ref").otherwise("submodule_ref")
    own = held.select("consumer_project_id", "dependency_project_id", kind.alias("reference_kind"), F.col("commit").alias("submodule_pinned_commit"))
    package = references.select(F.col("project_id").alias("consumer_project_id"), F.lit(0).cast("long").alias("dependency_project_id"), F.lit("nuget_ref").alias("reference_kind"), package_of_path("reference").alias("submodule_pinned_commit"))
    return own.unionByName(package.filter("submodule_pinned_commit is not null"))
