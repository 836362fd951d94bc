"""Bounded walks over edge tables, all nodes of a level at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..sources.versions import TASK_ROWS, materialize, tasks_for
from .source import with_context


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Many written rows dealt by keys before they are grouped, so that a task holds no more groups the more rows there are; few rows as they are."""
    rows = df.count()
    return df if rows <= TASK_ROWS else df.repartition(tasks_for(df.sparkSession, rows), *keys)


def bfs_edges(edges: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """Edges on the way from roots with their depth, 1 for those of a root itself.

    edges: (src, dst, ...); roots: (root, node), walked all at once; every edge of a node is
    met once, at the node's smallest depth, edges back to visited nodes included. Each
    level is one equi-join with the frontier; what is visited leaves by an anti join.
    """
    frontier = materialize(roots.select("root", "node").distinct())
    visited, out = frontier, []
    for depth in range(1, levels + 1):
        met = materialize(frontier.join(edges, F.col("node") == F.col("src")).drop("node").withColumn("depth", F.lit(depth)))
        out.append(met)
        if depth == levels:
            break
        fresh = materialize(_dealt(met.select("root", F.col("dst").alias("node")), "root", "node").distinct().join(visited, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        frontier, visited = fresh, visited.unionByName(fresh)
    return reduce(DataFrame.unionByName, out)


def _roots(ix: Index, fqn: str) -> DataFrame:
    return ix.symbols.filter(F.col("fqn") == fqn).orderBy("id").limit(1).select(F.col("id").alias("root"), F.col("id").alias("node"))


def call_hierarchy(ix: Index, symbol_fqn: str, direction: str = "callers", depth: int = 5, source: DataFrame | None = None, places: bool = True) -> DataFrame:
    """One row a call edge met: its symbol, depth and place. Any direction but callees means callers.

    With source (file_path, text) each has the lines around the call; without places files and lines of calls are left out.
    """
    met = call_hierarchies(ix, _roots(ix, symbol_fqn), direction, depth, places or source is not None)
    return met if source is None else with_context(met, source, "call_site_file", "call_site_line")


def call_hierarchies(ix: Index, roots: DataFrame, direction: str = "callers", depth: int = 5, places: bool = True) -> DataFrame:
    place = ("call_site_file", "call_site_line") if places else ()
    src, dst = ("caller_symbol_id", "callee_symbol_id") if direction == "callees" else ("callee_symbol_id", "caller_symbol_id")
    edges = ix.call_graph.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("id").alias("edge_id"), *place)
    met = bfs_edges(edges, roots, max(1, min(depth, ix.config.max_depth)))
    return met.join(ix.symbols.select(F.col("id").alias("dst"), "fqn", "file_path"), "dst").select("root", "edge_id", F.col("dst").alias("symbol_id"), "fqn", "depth", *place)


def call_reach(ix: Index, roots: DataFrame, direction: str = "callees", depth: int = 3) -> DataFrame:
    """(root, reached, edges): how many indexed symbols each root (root, node) reaches, and over how many calls.

    What `call_hierarchies` gives one row a call for is counted from one row a pair of symbols, with its number of calls.
    """
    src, dst = ("caller_symbol_id", "callee_symbol_id") if direction == "callees" else ("callee_symbol_id", "caller_symbol_id")
    pairs = _dealt(ix.call_graph.select(F.col(src).alias("src"), F.col(dst).alias("dst")), "src").groupBy("src", "dst").agg(F.count("*").alias("calls"))
    known = ix.symbols.groupBy(F.col("id").alias("dst")).agg(F.count("*").alias("known"))
    edges = materialize(pairs.join(known, "dst", "left").select("src", "dst", (F.col("calls") * F.coalesce("known", F.lit(0))).alias("calls")))
    met = bfs_edges(edges, roots, max(1, min(depth, ix.config.max_depth))).filter("calls > 0").select("root", "dst", "calls")
    each = _dealt(met, "root", "dst").groupBy("root", "dst").agg(F.sum("calls").alias("calls"))
    return each.groupBy("root").agg(F.count("*").alias("reached"), F.sum("calls").alias("edges"))


def type_hierarchy(ix: Index, symbol_fqn: str, direction: str = "both") -> DataFrame:
    """Base types (up) and derived types (down) by inheritance; other directions give none."""
    inherits = ix.relationships.filter(F.col("kind") == "inherits")
    ways = {"up": ("from_symbol_id", "to_symbol_id"), "down": ("to_symbol_id", "from_symbol_id")}
    parts = []
    for way, (src, dst) in ways.items():
        if direction in (way, "both"):
            edges = inherits.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
            parts.append(bfs_edges(edges, _roots(ix, symbol_fqn), ix.config.type_depth + 1).withColumn("direction", F.lit(way)))
    if not parts:
        return ix.symbols.filter(F.lit(False)).select(F.lit("").alias("direction"), F.col("id").alias("symbol_id"), "fqn", F.lit(0).alias("depth"))
    met = reduce(DataFrame.unionByName, parts)
    return met.join(ix.symbols.select(F.col("id").alias("dst"), "fqn"), "dst").select("direction", F.col("dst").alias("symbol_id"), "fqn", "depth")


def implementors(ix: Index, symbol_fqn: str) -> DataFrame:
    """Symbols that implement or override a symbol."""
    edges = ix.relationships.filter(F.col("kind").isin("implements", "overrides"))
    root = ix.symbols.filter(F.col("fqn") == symbol_fqn).orderBy("id").limit(1).select(F.col("id").alias("to_symbol_id"))
    hit = edges.join(root, "to_symbol_id", "left_semi").select("from_symbol_id", F.col("kind").alias("relationship"))
    return hit.join(ix.symbols, F.col("from_symbol_id") == F.col("id")).select(F.col("id").alias("symbol_id"), "fqn", "relationship")


def type_dependents(ix: Index, symbol_fqn: str, dependency_kind: str = "all") -> DataFrame:
    """(dependent, kind, via_member, file_path, line): incoming relationships, members rolled up to their type.

    A member whose type isn't indexed stands for itself. Both spellings of parameter_of hold.
    """
    from ..functions import containing_type

    kind = dependency_kind.replace("_", "").lower()
    edges = ix.relationships if kind == "all" else ix.relationships.filter(F.col("kind") == kind)
    root = ix.symbols.filter(F.col("fqn") == symbol_fqn).orderBy("id").limit(1).select(F.col("id").alias("to_symbol_id"))
    hit = edges.join(root, "to_symbol_id", "left_semi").select("from_symbol_id", F.col("kind").alias("dependency"))
    source = hit.join(ix.symbols, F.col("from_symbol_id") == F.col("id")).withColumn("holder", F.when(F.col("fqn").contains("("), containing_type("fqn")))
    types = ix.symbols.groupBy(F.col("fqn").alias("type_fqn")).agg(F.min("id").alias("type_id"))
    rolled = source.join(types, F.col("holder") == F.col("type_fqn"), "left")
    member = F.col("type_fqn").isNotNull()
    return rolled.select(F.when(member, F.col("type_fqn")).otherwise(F.col("fqn")).alias("dependent"), "dependency", F.when(member, F.col("fqn")).alias("via_member"), "file_path", F.col("line_start").alias("line"))


def project_dependencies(ix: Index, project: str, transitive: bool = False, reverse: bool = False) -> DataFrame:
    """Dependency edges of a project with their depth, 0 for its own; reverse gives its consumers."""
    ends = ("consumer_project_id", "dependency_project_id")
    src, dst = ends[::-1] if reverse else ends
    edges = ix.project_dependencies.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "reference_kind")
    roots = ix.projects.filter(F.col("canonical_id") == project).select(F.col("id").alias("root"), F.col("id").alias("node"))
    met = bfs_edges(edges, roots, 1000 if transitive else 1)
    return met.select(F.col("src").alias("from_project_id"), F.col("dst").alias("to_project_id"), "reference_kind", (F.col("depth") - 1).alias("depth"))


def dependent_files(ix: Index, changed: DataFrame) -> DataFrame:
    """(file_path): files that refer to symbols of changed files (column file_path), but those themselves."""
    changed = changed.select("file_path").distinct()
    symbols = ix.symbols.join(changed, "file_path", "left_semi").select(F.col("id").alias("symbol_id"))
    users = ix.refs.join(symbols, "symbol_id", "left_semi").select("file_path").distinct()
    return users.join(changed, "file_path", "left_anti")


def _settled(step, start: DataFrame, limit: int) -> DataFrame:
    """start put through step until nothing changes, each round written; step gives (rows, whether one changed)."""
    now = start
    for _ in range(limit):
        now, changed = step(now)
        if not changed:
            return now
    raise RuntimeError(f"the walk still changes after {limit} rounds")


def _peeled(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (src, dst) that may lie on a cycle: those left when ends without a way on, or without a way in, have gone."""

    def step(e: DataFrame) -> tuple[DataFrame, bool]:
        inner = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
        kept = materialize(e.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi"))
        return kept, kept.count() < e.count()

    return _settled(step, edges, limit)


def _spread(labels: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """labels (node, label) with each node's label the largest one that leads to it over edges."""

    def step(now: DataFrame) -> tuple[DataFrame, bool]:
        sent = edges.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("sent"))
        new = materialize(now.join(sent, "node", "left").select("node", F.greatest("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") > F.col("label")).alias("rose")))
        return new.select("node", "label"), not new.filter("rose").isEmpty()

    return _settled(step, labels, limit)


def cycles(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """(node, cycle) of nodes that lie on a cycle of edges (src, dst); cycle is the smallest node of all that reach each other.

    Ends are peeled off first. Then the largest node that leads to a node is its label, and of a
    label's nodes those from which the label's own node can be reached are a whole cycle; they go,
    and the rest is worked on again. Rounds grow with the longest way, not with the rows; beyond
    limit rounds an error is raised. An edge from a node to itself is a cycle of one.
    """
    own = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    left = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    found = []
    for _ in range(limit):
        left = _peeled(left, limit)
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        label = _spread(materialize(nodes.withColumn("label", F.col("node"))), left, limit)
        ends = [label.select(F.col("node").alias(e), F.col("label").alias(f"of_{e}")) for e in ("src", "dst")]
        inside = materialize(left.join(ends[0], "src").join(ends[1], "dst").filter("of_src = of_dst").select("src", "dst"))
        # backwards inside a label: whether the label's own node can be reached
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        seen = label.select("node", (F.col("node") == F.col("label")).cast("int").alias("label"))
        reach = _spread(materialize(seen), back, limit).filter("label = 1").select("node")
        ring = materialize(label.join(reach, "node", "left_semi"))
        found.append(ring.join(ring.groupBy("label").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).filter("n > 1"), "label").select("node", "cycle"))
        gone = ring.select("node")
        left = materialize(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    else:
        raise RuntimeError(f"cycles remain after {limit} rounds")
    rings = reduce(DataFrame.unionByName, found, own.limit(0).select("node", F.col("node").alias("cycle")))
    return rings.unionByName(own.join(rings, "node", "left_anti").select("node", F.col("node").alias("cycle")))


def dependency_levels(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """(node, level, cycle) of the nodes of edges (src depends on dst).

    A node that depends on nothing has level 0, others one more than the highest they depend
    on; nodes of a cycle count as one and share a level, and cycle is the smallest of them, else
    null. Levels come by peeling: each round takes what depends on settled nodes only. Repeated
    edges and those with a null end don't count; beyond limit rounds an error is raised.
    """
    edges = materialize(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    ring = materialize(cycles(edges, limit))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    group = materialize(nodes.join(ring, "node", "left").withColumn("group", F.coalesce("cycle", "node")))
    of = lambda end: group.select(F.col("node").alias(end), F.col("group").alias(f"g_{end}"))
    left = materialize(edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).filter("src <> dst").distinct())
    todo = materialize(group.select("group").distinct())
    settled = []
    for level in range(limit):
        ready = materialize(todo.join(left, F.col("group") == F.col("src"), "left_anti"))
        settled.append(ready.withColumn("level", F.lit(level).cast("long")))
        todo = materialize(todo.join(ready, "group", "left_anti"))
        if todo.isEmpty():
            break
        left = materialize(left.join(ready, F.col("dst") == F.col("group"), "left_anti"))
    else:
        raise RuntimeError(f"levels remain after {limit} rounds")
    return group.join(reduce(DataFrame.unionByName, settled), "group").select("node", "level", "cycle")
