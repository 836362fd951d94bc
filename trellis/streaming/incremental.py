"""Incremental maintenance by content hash: the result is as if rebuilt from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..operators.graph import dependent_files
from ..operators.maintenance import cascade_delete, delete_keys, upsert
from ..schemas import KEYS
from ..sources.versions import materialize

#: Tables whose rows belong to a file of a project, and where they name the two.
BY_FILE = {"refs": ("in_project_id", "file_path"), "comments": ("project_id", "file_path")}


def changed_files(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(project_id, file_path, content_hash, change) of a full listing against the file index: added, changed or deleted."""
    old = known.select("project_id", "file_path", F.col("content_hash").alias("old_hash"))
    both = listing.select("project_id", "file_path", "content_hash").join(old, ["project_id", "file_path"], "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("content_hash").isNull(), "deleted").when(F.col("content_hash") != F.col("old_hash"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("project_id", "file_path", "content_hash", "change")


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fqn, file_path) of symbols on both sides whose known hashes differ."""
    o = old.select("project_id", "fqn", F.col("signature_hash").alias("old_hash"))
    return new.join(o, ["project_id", "fqn"]).filter("signature_hash <> old_hash").select("project_id", "fqn", "file_path")


def work_order(items: DataFrame) -> DataFrame:
    """Items (priority, seq, ...) as a queue hands them out: immediate ones first, in order of arrival."""
    return items.orderBy((F.col("priority") != "immediate").cast("int"), "seq")


def cascade_items(ix: Index, changed_signatures: DataFrame) -> DataFrame:
    """(file_path, priority): files to look at again in the background as signatures they use have changed."""
    return dependent_files(ix, changed_signatures).withColumn("priority", F.lit("background"))


def apply_changes(ix: Index, changes: DataFrame, fresh: dict[str, DataFrame]) -> Index:
    """ix with the rows of changed files replaced by those extracted anew.

    changes: (project_id, file_path, content_hash, change); fresh: tables of rows of the
    added and changed files. Symbols keep their id by name, so what other files hold on
    them stays; a symbol that is gone takes it along.
    """
    # written, as many tables leave out rows by them: their sizes are known to each join
    files = materialize(changes.select("project_id", "file_path").distinct())
    own = ix.symbols.join(files, ["project_id", "file_path"], "left_semi")
    new = fresh.get("symbols", ix.symbols.filter(F.lit(False)))
    held = materialize(own.join(new.select("project_id", "fqn"), ["project_id", "fqn"], "left_anti").select("id").distinct())
    out = cascade_delete(ix, symbols=held)
    tables: dict[str, DataFrame] = {"symbols": upsert(out.symbols, new, KEYS["symbols"], "last_indexed_at")}
    for name, (project, path) in BY_FILE.items():
        rest = delete_keys(out[name], files, {project: "project_id", path: "file_path"})
        tables[name] = rest.unionByName(fresh[name]) if name in fresh else rest
    # a call is of its caller's project; only calls in files of a changed one's name are joined with their callers
    callers = ix.symbols.select(F.col("id").alias("caller_symbol_id"), "project_id")
    names = files.select(F.col("file_path").alias("call_site_file")).distinct()
    near = out.call_graph.join(names, "call_site_file", "left_semi")
    made = near.join(callers, "caller_symbol_id").join(files.withColumnRenamed("file_path", "call_site_file"), ["project_id", "call_site_file"], "left_semi")
    rest = out.call_graph.join(names, "call_site_file", "left_anti").unionByName(delete_keys(near, made.select("id"), {"id": "id"}))
    tables["call_graph"] = materialize((rest.unionByName(fresh["call_graph"]) if "call_graph" in fresh else rest).select(*ix.call_graph.columns))
    calls = tables["call_graph"].select(F.col("id").alias("call_graph_id"))
    for name in ("argument_flow", "return_flow"):
        # without new calls those that are left are among those of the cascade, which needs no join of its own then
        rest = (out if "call_graph" in fresh else ix)[name].join(calls, "call_graph_id", "left_semi")
        tables[name] = rest.unionByName(fresh[name]) if name in fresh else rest
    from_file = own.select("id")
    rest = delete_keys(out.relationships, from_file, {"from_symbol_id": "id"})
    tables["relationships"] = rest.unionByName(fresh["relationships"]) if "relationships" in fresh else rest
    known = delete_keys(ix.file_index, files, {"project_id": "project_id", "file_path": "file_path"})
    stay = changes.filter("change <> 'deleted'").select(F.xxhash64("project_id", "file_path").alias("id"), "project_id", "file_path", "content_hash", F.unix_millis(F.current_timestamp()).alias("last_indexed_at"))
    tables["file_index"] = known.unionByName(stay)
    return out.replace(**tables)


def rebuilt_equals(a: Index, b: Index, tables: tuple[str, ...] = ("symbols", "refs", "relationships", "comments")) -> bool:
    """Whether two indexes hold the same rows but for times of indexing."""
    for t in tables:
        x, y = a[t].drop("last_indexed_at"), b[t].drop("last_indexed_at")
        if not (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()):
            return False
    return True
