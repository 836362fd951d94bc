"""Tables of a code index: one explicit schema each, and the enumerations in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 6


_TYPES = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType()}


def _s(columns: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


TABLES: dict[str, StructType] = {
    "projects": _s("id bigint, canonical_id string, git_remote_url string, repo_relative_path string, disk_path string, assembly_name string, target_framework string, is_test_project boolean, last_indexed_at bigint"),
    "symbols": _s("id bigint, project_id bigint, fqn string, display_name string, kind string, accessibility string, is_static boolean, is_abstract boolean, is_virtual boolean, is_override boolean, signature string, signature_hash string, doc_comment string, file_path string, line_start int, line_end int, attributes string, last_indexed_at bigint"),
    "refs": _s("id bigint, symbol_id bigint, in_project_id bigint, file_path string, line int, context_snippet string, reference_kind string, access_kind string, last_indexed_at bigint"),
    "relationships": _s("id bigint, from_symbol_id bigint, to_symbol_id bigint, kind string, last_indexed_at bigint"),
    "call_graph": _s("id bigint, caller_symbol_id bigint, callee_symbol_id bigint, call_site_file string, call_site_line int, last_indexed_at bigint"),
    "file_index": _s("id bigint, project_id bigint, file_path string, content_hash string, last_indexed_at bigint"),
    "project_dependencies": _s("id bigint, consumer_project_id bigint, dependency_project_id bigint, reference_kind string, submodule_pinned_commit string"),
    "snapshots": _s("id bigint, project_id bigint, symbol_id bigint, fqn string, accessibility string, signature_hash string, captured_at bigint, git_commit string"),
    "solutions": _s("id bigint, file_path string, name string, last_indexed_at bigint"),
    "solution_projects": _s("solution_id bigint, project_id bigint"),
    "comments": _s("id bigint, project_id bigint, file_path string, line int, tag string, text string, enclosing_symbol_id bigint, last_indexed_at bigint"),
    "argument_flow": _s("id bigint, call_graph_id bigint, parameter_ordinal int, parameter_name string, argument_expression string, argument_kind string, source_symbol_fqn string, last_indexed_at bigint"),
    "return_flow": _s("id bigint, call_graph_id bigint, destination_kind string, destination_variable string, destination_symbol_fqn string, last_indexed_at bigint"),
}

#: Unique keys, by which an upsert finds the row to replace.
KEYS: dict[str, tuple[str, ...]] = {
    "projects": ("canonical_id",),
    "symbols": ("fqn", "project_id"),
    "project_dependencies": ("consumer_project_id", "dependency_project_id"),
    "file_index": ("project_id", "file_path"),
    "solutions": ("file_path",),
    "solution_projects": ("solution_id", "project_id"),
}

#: Texts of the enumerations.
TYPE_KINDS = ("class", "interface", "struct", "enum", "delegate", "record")
MEMBER_KINDS = ("method", "constructor", "property", "field", "event", "indexer")
REFERENCE_KINDS = ("invocation", "typeref", "attribute", "inheritance", "override", "objectcreation")
RELATIONSHIP_KINDS = ("inherits", "implements", "overrides", "instantiates", "returns", "parameterof")
ACCESS_KINDS = ("read", "write", "readwrite")
DEPENDENCY_KINDS = ("project_ref", "submodule_ref", "nuget_ref")
COMMENT_TAGS = ("TODO", "HACK", "FIXME", "BUG", "NOTE", "UNDONE")
ACCESSIBILITY_RANK = {"public": 5, "protected_internal": 4, "protected": 3, "internal": 2, "private_protected": 1, "private": 0}
API_ACCESSIBILITY = ("public", "protected")
#: Attributes that mark a test, and frameworks in order of detection.
TEST_ATTRIBUTES = (
    "global::Xunit.FactAttribute",
    "global::Xunit.TheoryAttribute",
    "global::NUnit.Framework.TestAttribute",
    "global::NUnit.Framework.TestCaseAttribute",
    "global::Microsoft.VisualStudio.TestTools.UnitTesting.TestMethodAttribute",
)
TEST_FRAMEWORKS = (("Xunit", "xunit"), ("NUnit", "nunit"), ("Microsoft.VisualStudio.TestTools", "mstest"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table, in order and of its types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])
