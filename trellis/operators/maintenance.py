"""Changes to tables, as new versions of them: upserts, deletes and what follows from deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..schemas import KEYS


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """table with rows put in; of rows with equal keys the last by order, then by all columns, wins, and keeps the id of the row it replaces."""
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("order"), F.struct(*rows.columns).alias("r"))).alias("m")).select("m.r.*")
    if "id" in table.columns and "id" not in keys:
        held = table.groupBy(*keys).agg(F.min("id").alias("__held"))
        last = last.join(held, list(keys), "left").withColumn("id", F.coalesce("__held", "id")).drop("__held")
    return table.join(last, list(keys), "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """table with those rows whose keys it lacks, each once: the first by all columns."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return table.unionByName(first.join(table, list(keys), "left_anti").select(*table.columns))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def delete_keys(table: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """table without the rows whose columns (keys of on) match columns of gone (values)."""
    out = gone.select(*[F.col(g).alias(f"__{t}") for t, g in on.items()]).distinct()
    match = [F.col(t) == F.col(f"__{t}") for t in on]
    return table.join(out, match, "left_anti")


def set_null(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """table with a column emptied where it holds one of the ids of gone (column id)."""
    out = gone.select(F.col("id").alias("__gone")).distinct()
    joined = table.join(out, F.col(column) == F.col("__gone"), "left")
    return joined.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*table.columns)


def cascade_delete(ix: Index, symbols: DataFrame | None = None, projects: DataFrame | None = None) -> Index:
    """ix without some symbols or projects (column id) and all that hangs on them.

    References, relationships, calls and flows go with their symbol; comments lose it.
    Snapshots hold names of their own and stay.
    """
    if projects is not None:
        under = ix.symbols.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("id")
        symbols = under if symbols is None else symbols.select("id").unionByName(under)
    changed: dict[str, DataFrame] = {}
    if symbols is not None:
        changed["symbols"] = delete_keys(ix.symbols, symbols, {"id": "id"})
        changed["refs"] = delete_keys(ix.refs, symbols, {"symbol_id": "id"})
        changed["relationships"] = delete_keys(delete_keys(ix.relationships, symbols, {"from_symbol_id": "id"}), symbols, {"to_symbol_id": "id"})
        calls = delete_keys(delete_keys(ix.call_graph, symbols, {"caller_symbol_id": "id"}), symbols, {"callee_symbol_id": "id"})
        changed["call_graph"] = calls
        kept = calls.select(F.col("id").alias("call_graph_id"))
        for flow in ("argument_flow", "return_flow"):
            changed[flow] = ix[flow].join(kept, "call_graph_id", "left_semi")
        changed["comments"] = set_null(ix.comments, "enclosing_symbol_id", symbols)
    if projects is not None:
        changed["projects"] = delete_keys(ix.projects, projects, {"id": "id"})
        changed["refs"] = delete_keys(changed["refs"], projects, {"in_project_id": "id"})
        changed["project_dependencies"] = delete_keys(delete_keys(ix.project_dependencies, projects, {"consumer_project_id": "id"}), projects, {"dependency_project_id": "id"})
        for name in ("comments", "file_index", "solution_projects"):
            changed[name] = delete_keys(changed.get(name, ix[name]), projects, {"project_id": "id"})
    return ix.replace(**changed)


def resolve_names(edges: DataFrame, symbols: DataFrame, name: str, out: str) -> DataFrame:
    """edges with the id of a named symbol as out; edges to unknown names go; of equal names the last id wins."""
    ids = symbols.groupBy(F.col("fqn").alias(name)).agg(F.max("id").alias(out))
    return edges.join(ids, name).drop(name)


def keys_of(table: str) -> tuple[str, ...]:
    return KEYS[table]
