"""References to symbols, and values that flow through calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..schemas import ACCESS_KINDS
from .scope import project_names, with_scope
from .source import with_context

#: Columns by which references group.
GROUP_KEYS = {"project": "project", "file": "file_path", "kind": "reference_kind"}


def _first(ix: Index, fqn: str) -> DataFrame:
    return ix.symbols.filter(F.col("fqn") == fqn).orderBy("id").limit(1)


def find_references(ix: Index, symbol_fqn: str, include_projects: str | None = None, scope: str | None = None, access_kind: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """References to the first symbol of a name, with the canonical id of their project.

    include_projects: comma-separated canonical ids, of which unknown ones find nothing. An
    access kind that is none of the known ones filters nothing. With source (file_path, text) each has the lines around it.
    """
    target = _first(ix, symbol_fqn).select(F.col("id").alias("symbol_id"))
    rows = ix.refs.join(target, "symbol_id", "left_semi")
    if include_projects is not None:
        names = [p.strip() for p in include_projects.split(",") if p.strip()]
        chosen = ix.projects.filter(F.col("canonical_id").isin(names)).select(F.col("id").alias("in_project_id"))
        rows = rows.join(chosen, "in_project_id", "left_semi")
    rows = with_scope(ix, rows, scope, project_col="in_project_id")
    if access_kind is not None and access_kind.lower() in ACCESS_KINDS:
        rows = rows.filter(F.col("access_kind") == access_kind.lower())
    rows = project_names(ix, rows, "in_project_id")
    return rows if source is None else with_context(rows, source)


def group_counts(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of references by every prefix of keys, one rollup: (level, the keys' columns, count)."""
    columns = [GROUP_KEYS[k] for k in keys]
    return refs.rollup(*columns).agg(F.count("*").alias("count"), F.grouping_id().alias("level"))


def grouped_references(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Nested groups (group_key, group_type, count, items), the first key outermost; an unknown key is one group, unknown."""
    columns = [(k, GROUP_KEYS.get(k)) for k in keys]
    rows = refs.withColumns({f"__k{i}": F.col(c) if c else F.lit("unknown") for i, (_, c) in enumerate(columns)})
    item = F.struct("file_path", "line", "reference_kind", "access_kind", "project", "context_snippet")
    outer = [f"__k{i}" for i in range(len(columns))]
    nested = rows.groupBy(*outer).agg(F.count("*").alias("count"), F.sort_array(F.collect_list(item)).alias("items"))
    for i in range(len(columns) - 1, 0, -1):
        group = F.struct(F.col(f"__k{i}").alias("group_key"), F.lit(columns[i][0]).alias("group_type"), "count", "items")
        nested = nested.groupBy(*outer[:i]).agg(F.sum("count").alias("total"), F.sort_array(F.collect_list(group)).alias("items")).withColumnRenamed("total", "count")
    return nested.select(F.col("__k0").alias("group_key"), F.lit(columns[0][0]).alias("group_type"), "count", "items").orderBy("group_key")


def trace_origins(ix: Index, method_fqn: str, parameter: str | None = None) -> DataFrame:
    """Arguments of all calls of a method, one row a parameter name with its first ordinal and its arguments.

    A number as parameter keeps the names that any argument has at that ordinal.
    """
    target = _first(ix, method_fqn).select(F.col("id").alias("callee_symbol_id"))
    calls = ix.call_graph.join(target, "callee_symbol_id", "left_semi").select(F.col("id").alias("call_graph_id"), "caller_symbol_id", "call_site_line")
    flows = ix.argument_flow.drop("id").join(calls, "call_graph_id")
    callers = ix.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("fqn").alias("caller"))
    rows = flows.join(callers, "caller_symbol_id")
    item = F.struct("caller", "call_site_line", "argument_expression", "argument_kind")
    first = F.min(F.struct("call_graph_id", "parameter_ordinal"))["parameter_ordinal"]
    grouped = rows.groupBy("parameter_name").agg(first.alias("ordinal"), F.count("*").alias("count"), F.collect_set("parameter_ordinal").alias("__all"), F.sort_array(F.collect_list(item)).alias("origins"))
    if parameter is not None:
        grouped = grouped.filter(F.array_contains("__all", int(parameter)) if parameter.isdigit() else F.col("parameter_name") == parameter)
    return grouped.drop("__all")


def trace_destinations(ix: Index, method_fqn: str) -> DataFrame:
    """One row a call of a method: the first place its result goes, or unknown."""
    target = _first(ix, method_fqn).select(F.col("id").alias("callee_symbol_id"))
    calls = ix.call_graph.join(target, "callee_symbol_id", "left_semi").select(F.col("id").alias("call_graph_id"), "caller_symbol_id", "call_site_line")
    flow = F.min(F.struct("id", "destination_kind", "destination_variable", "destination_symbol_fqn"))
    first = ix.return_flow.join(calls.select("call_graph_id"), "call_graph_id", "left_semi").groupBy("call_graph_id").agg(flow.alias("f"))
    callers = ix.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("fqn").alias("caller"))
    joined = calls.join(first, "call_graph_id", "left").join(callers, "caller_symbol_id")
    return joined.select("call_graph_id", "caller", "call_site_line", F.coalesce("f.destination_kind", F.lit("unknown")).alias("destination_kind"), F.col("f.destination_variable").alias("destination_variable"))
