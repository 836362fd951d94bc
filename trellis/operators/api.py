"""API surfaces: snapshots, their differences, and who is hit by a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..functions import accessibility_rank, signature_hash
from ..schemas import API_ACCESSIBILITY
from .scope import in_project, project_names

#: Classes of change by severity.
SEVERITY = ("nonbreaking", "additive", "breaking")


def _surface(ix: Index, project: str | None) -> DataFrame:
    rows = in_project(ix, ix.symbols.filter(F.col("accessibility").isin(*API_ACCESSIBILITY)), project)
    return rows.withColumn("signature_hash", F.coalesce("signature_hash", signature_hash("signature", "fqn")))


def api_surface(ix: Index, project: str, compare_to_commit: str | None = None) -> DataFrame:
    """Public and protected symbols of a project, or what changed in them since a commit's snapshot."""
    now = _surface(ix, project)
    if compare_to_commit is None:
        return now
    old = in_project(ix, ix.snapshots, project).filter(F.col("git_commit") == compare_to_commit)
    return diff_surfaces(old, now)


def diff_surfaces(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fqn, classification, reason) of the names that differ; both sides have fqn, signature_hash, accessibility.

    A name that repeats on a side counts once, as its first id or symbol_id.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        key = "symbol_id" if "symbol_id" in df.columns else "id"
        one = df.groupBy("fqn").agg(F.min_by(F.struct("signature_hash", "accessibility"), key).alias(mark))
        return one.select("fqn", F.col(f"{mark}.signature_hash").alias(f"{mark}_hash"), F.col(f"{mark}.accessibility").alias(f"{mark}_access"), F.lit(True).alias(mark))

    both = side(old, "old").join(side(new, "new"), "fqn", "full_outer")
    reason = (
        F.when(F.col("new").isNull(), "Symbol removed")
        .when(F.col("old").isNull(), "Symbol added")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "Signature changed")
        .when(accessibility_rank("new_access") < accessibility_rank("old_access"), "Accessibility reduced")
    )
    return both.select("fqn", reason.alias("reason")).filter("reason is not null").select("fqn", F.when(F.col("reason") == "Symbol added", "additive").otherwise("breaking").alias("classification"), "reason")


def overall_change(changes: DataFrame) -> DataFrame:
    """One row: the most severe classification; nonbreaking for no change."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("classification"))
    return changes.agg(F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("overall"))


def latest_snapshot(ix: Index, project: str | None = None) -> DataFrame:
    """Rows of each project's latest capture, all of those at that time."""
    rows = in_project(ix, ix.snapshots, project)
    last = rows.groupBy("project_id").agg(F.max("captured_at").alias("captured_at"))
    return rows.join(last, ["project_id", "captured_at"], "left_semi")


def previous_commit(ix: Index, project: str, current_commit: str) -> DataFrame:
    """(git_commit) of the latest capture of a project at another commit."""
    rows = in_project(ix, ix.snapshots, project).filter(F.col("git_commit") != current_commit)
    return rows.groupBy("git_commit").agg(F.max("captured_at").alias("captured_at")).orderBy(F.desc("captured_at"), "git_commit").limit(1)


def surface_changes(ix: Index, project: str, old_commit: str, new_commit: str) -> DataFrame:
    rows = in_project(ix, ix.snapshots, project)
    return diff_surfaces(rows.filter(F.col("git_commit") == old_commit), rows.filter(F.col("git_commit") == new_commit))


def capture_snapshot(ix: Index, git_commit: str, captured_at: int) -> DataFrame:
    """The snapshot table with a commit's surface of all projects that others depend on, in place of an earlier one."""
    needed = ix.project_dependencies.select(F.col("dependency_project_id").alias("project_id")).distinct()
    fresh = _surface(ix, None).join(needed, "project_id", "left_semi").select(F.xxhash64("project_id", "fqn", F.lit(git_commit)).alias("id"), "project_id", F.col("id").alias("symbol_id"), "fqn", "accessibility", "signature_hash", F.lit(captured_at).cast("long").alias("captured_at"), F.lit(git_commit).alias("git_commit"))
    projects = fresh.select("project_id").distinct()
    rest = ix.snapshots.filter(F.col("git_commit") != git_commit).unionByName(ix.snapshots.filter(F.col("git_commit") == git_commit).join(projects, "project_id", "left_anti"))
    return rest.unionByName(fresh)


def impact(ix: Index, symbol_fqn: str) -> DataFrame:
    """Projects that depend directly on the symbol's project, with their references to it and what changed.

    The classification is that of the whole project, its latest snapshot against the most
    recent other commit; it is null unless the symbol is in the latest snapshot and there is another commit.
    """
    root = ix.symbols.filter(F.col("fqn") == symbol_fqn).orderBy("id").limit(1).select("id", "project_id").head()
    deps = ix.project_dependencies
    if root is None:
        return deps.filter(F.lit(False)).select(F.col("consumer_project_id"), F.lit("").alias("project"), F.lit(0).cast("long").alias("reference_count"), "submodule_pinned_commit", F.lit(False).alias("pin_includes_current"), F.lit(False).alias("is_api_surface"), F.lit("").alias("change_classification"))
    consumers = deps.filter(F.col("dependency_project_id") == root.project_id)
    counts = ix.refs.filter((F.col("symbol_id") == root.id) & (F.col("in_project_id") != root.project_id)).groupBy("in_project_id").agg(F.count("*").alias("n"))
    name = ix.projects.filter(F.col("id") == root.project_id).select("canonical_id").head().canonical_id
    latest = latest_snapshot(ix, name)
    on_surface = not latest.filter(F.col("symbol_id") == root.id).isEmpty()
    change = None
    if on_surface:
        commit = latest.orderBy("git_commit").select("git_commit").head().git_commit
        before = previous_commit(ix, name, commit).head()
        if before is not None:
            change = overall_change(surface_changes(ix, name, before.git_commit, commit)).head().overall
    rows = consumers.join(counts, F.col("consumer_project_id") == F.col("in_project_id"), "left")
    named = project_names(ix, rows, "consumer_project_id")
    return named.select("consumer_project_id", "project", F.coalesce("n", F.lit(0)).alias("reference_count"), "submodule_pinned_commit", F.col("submodule_pinned_commit").isNotNull().alias("pin_includes_current"), F.lit(on_surface).alias("is_api_surface"), F.lit(change).cast("string").alias("change_classification"))
