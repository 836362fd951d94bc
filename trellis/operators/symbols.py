"""Lookups and reports over symbols, comments and source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Index
from ..functions import attribute_list, citations, containing_type, count_parameters, like_contains, namespace_of, simple_name, test_framework
from ..schemas import MEMBER_KINDS, TEST_ATTRIBUTES, TEST_FRAMEWORKS, TYPE_KINDS
from .intervals import counts_inside, innermost
from .scope import in_project, project_names, project_named, with_scope
from .search import match_terms
from .source import lines_of, with_declaration


def find_symbol(ix: Index, name: str, kind: str | None = None, project_id: str | None = None, fuzzy: bool = False, scope: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Exact: the first symbol of a qualified name, in a project if given; kind doesn't count.

    Fuzzy: the best matches of a full-text query, of a kind if given; the project doesn't count.
    Either way the scope filters what was found. With source (file_path, text) each has the
    lines of its declaration.
    """
    if fuzzy:
        where = None if kind is None else F.lower("kind") == kind.lower()
        found = match_terms(ix.symbols, "id", ("display_name", "doc_comment"), name, ix.config.fts_max, where)
        rows = ix.symbols.join(F.broadcast(found), "id")
    else:
        rows = in_project(ix, ix.symbols.filter(F.col("fqn") == name), project_id).orderBy("id").limit(1)
    rows = project_names(ix, with_scope(ix, rows, scope))
    return rows if source is None else with_declaration(rows, source)


def file_symbols(ix: Index, file_path: str) -> DataFrame:
    return ix.symbols.filter(F.col("file_path") == file_path)


def type_members(ix: Index, symbol_fqn: str, include_inherited: bool = False) -> DataFrame:
    """Members of a type: symbols of member kinds in its file under its name; then those of its direct bases."""
    types = ix.symbols.filter(F.col("fqn") == symbol_fqn).orderBy("id").limit(1)
    wanted = types.select("id", F.col("fqn").alias("type_fqn"), F.col("file_path").alias("type_file"), F.lit(False).alias("inherited"))
    if include_inherited:
        edges = ix.relationships.filter(F.col("kind") == "inherits").join(types.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")
        bases = edges.select("to_symbol_id").join(ix.symbols, F.col("to_symbol_id") == F.col("id"))
        wanted = wanted.unionByName(bases.select("id", F.col("fqn").alias("type_fqn"), F.col("file_path").alias("type_file"), F.lit(True).alias("inherited")))
    members = ix.symbols.filter(F.col("kind").isin(*MEMBER_KINDS))
    under = (members["file_path"] == F.col("type_file")) & members["fqn"].startswith(F.concat("type_fqn", F.lit(".")))
    return members.join(wanted.drop("id"), under).drop("type_file")


def index_status(ix: Index) -> DataFrame:
    """Each project with its numbers of symbols and references, the last indexed first."""
    symbols = ix.symbols.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("symbol_count"))
    refs = ix.refs.groupBy(F.col("in_project_id").alias("id")).agg(F.count("*").alias("reference_count"))
    rows = ix.projects.join(symbols, "id", "left").join(refs, "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("canonical_id", "is_test_project", "last_indexed_at", count("symbol_count"), count("reference_count")).orderBy(F.desc("last_indexed_at"), "canonical_id")


def freshness(df: DataFrame, column: str = "last_indexed_at") -> DataFrame:
    """One row: the smallest positive time, 0 for none."""
    return df.agg(F.coalesce(F.min(F.when(F.col(column) > 0, F.col(column))), F.lit(0)).alias("index_freshness"))


def daemon_status(query) -> dict:
    """State of a streaming query in the terms of an index service."""
    last = query.lastProgress if query is not None else None
    return {"running": bool(query is not None and query.isActive), "status": query.status if query is not None else None, "last_batch": None if last is None else last["batchId"], "rows_per_second": None if last is None else last.get("processedRowsPerSecond")}


def service_status(ix: Index, queue: DataFrame, state: str = "idle", phase: str | None = None, started_at: int | None = None) -> DataFrame:
    """One row: the state of an index service, with its queue (priority) counted by level and the last time of indexing."""
    level = lambda now: F.count(F.when((F.col("priority") == "immediate") == now, 1))
    waiting = queue.agg(level(True).alias("queued_files"), level(False).alias("background_tasks"))
    last = ix.projects.agg(F.max(F.when(F.col("last_indexed_at") > 0, F.col("last_indexed_at"))).alias("last_indexed_at"), F.count("*").alias("project_count"))
    start = F.lit(started_at).cast("long")
    # both sides are one row
    both = waiting.join(F.broadcast(last), F.lit(True))
    return both.select(F.lit(state).alias("state"), "queued_files", "background_tasks", "last_indexed_at", "project_count", F.lit(phase).cast("string").alias("phase"), start.alias("indexing_started_at"), (F.unix_millis(F.current_timestamp()) - start).alias("elapsed_ms"))


def find_by_attribute(ix: Index, attribute_fqn: str, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """Symbols that carry an attribute, by name; attributes that aren't a JSON array of texts count for nothing."""
    rows = ix.symbols.filter(F.array_contains(attribute_list("attributes"), attribute_fqn))
    if kind is not None:
        rows = rows.filter(F.lower("kind") == kind.lower())
    return with_scope(ix, rows, scope).orderBy("fqn", "id")


def find_by_signature(ix: Index, return_type: str | None = None, parameter_type: str | None = None, parameter_count: int | None = None, kind: str | None = None, project_id: str | None = None, max_results: int = 50, strict_topk: bool = False) -> DataFrame:
    """Methods and constructors, or symbols of a kind, by their signature.

    As in the interface that this follows, the number of parameters filters the first
    2 * max_results rows (in order of id); strict_topk filters all rows by it first.
    """
    rows = ix.symbols.filter(F.col("signature").isNotNull())
    rows = rows.filter(F.col("kind").isin("method", "constructor") if kind is None else F.lower("kind") == kind.lower())
    if return_type is not None:
        rows = rows.filter(like_contains("signature", f"{return_type} "))
    if parameter_type is not None:
        rows = rows.filter(like_contains("signature", f"(%{parameter_type}"))
    rows = in_project(ix, rows, project_id)
    if not strict_topk:
        rows = rows.orderBy("id").limit(2 * max_results)
    if parameter_count is not None:
        rows = rows.filter(count_parameters("signature") == parameter_count)
    return rows.orderBy("id").limit(max_results)


def find_comments(ix: Index, tag: str = "all", search: str | None = None, project_id: str | None = None, in_symbol: str | None = None, max_results: int = 50) -> DataFrame:
    """Tagged comments with the name of the symbol around them.

    A symbol comes before a search, which comes before a tag; the project doesn't count
    with a symbol; a tag holds in all of them.
    """
    rows = ix.comments
    if in_symbol is not None:
        target = ix.symbols.filter(F.col("fqn") == in_symbol).orderBy("id").limit(1).select(F.col("id").alias("enclosing_symbol_id"))
        rows = rows.join(target, "enclosing_symbol_id", "left_semi")
    else:
        if search is not None:
            rows = rows.filter(like_contains("text", search))
        if project_id is not None:
            rows = rows.filter(F.col("project_id") == F.lit(project_named(ix, project_id)))
    if tag.lower() != "all":
        rows = rows.filter(F.upper("tag") == tag.upper())
    order = ["line", "id"] if in_symbol is not None else ["file_path", "line", "id"]
    top = rows.orderBy(*order).limit(max_results)
    names = ix.symbols.select(F.col("id").alias("enclosing_symbol_id"), F.col("fqn").alias("enclosing_symbol"))
    return top.join(names, "enclosing_symbol_id", "left").orderBy(*order)


def enclosing_symbols(ix: Index, comments: DataFrame) -> DataFrame:
    """comments with the innermost symbol around them: of the same file and project, the one that begins last."""
    best = innermost(comments, ix.symbols, ["project_id", "file_path"]).withColumnRenamed("id", "enclosing_symbol_id")
    return comments.drop("enclosing_symbol_id").join(best, ["project_id", "file_path", "line"], "left")


def find_tests(ix: Index, for_symbol: str | None = None, framework: str = "all", max_results: int | None = 50) -> DataFrame:
    """Test methods, or those of a symbol: whose lines hold a reference to it, or if there is none, by name; None gives all."""
    prefixes = [p for p, name in TEST_FRAMEWORKS if name == framework.lower()]
    wanted = [a for a in TEST_ATTRIBUTES if not prefixes or any(p in a for p in prefixes)]
    carried = attribute_list("attributes")
    tests = ix.symbols.filter(F.arrays_overlap(carried, F.array(*map(F.lit, wanted)))).withColumn("framework", test_framework(carried))
    if for_symbol is not None:
        target = ix.symbols.filter(F.col("fqn") == for_symbol).orderBy("id").limit(1)
        uses = ix.refs.join(target.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("file_path", "line").distinct()
        direct = tests.join(counts_inside(tests, uses, ["file_path"]), "id", "left_semi")
        name = target.select(F.lower(simple_name("fqn")).alias("target"))
        holder = F.lower(F.coalesce(simple_name(containing_type("fqn")), simple_name("fqn")))
        by_name = tests.join(F.broadcast(name), F.lower("display_name").contains(F.col("target")) | holder.contains(F.col("target"))).drop("target")
        # one row that says whether anything refers to it
        found = direct.limit(1).select(F.lit(1).alias("__found"))
        tests = direct.unionByName(by_name.join(F.broadcast(found), F.lit(True), "left_anti"))
    return tests if max_results is None else tests.orderBy("id").limit(max_results)


def find_unreferenced(ix: Index, kind: str | None = None, project_id: str | None = None, exclude_test_projects: bool = True, accessibility: str | None = None) -> DataFrame:
    """Symbols that nothing refers to, by file and line."""
    rows = ix.symbols
    if kind is not None:
        rows = rows.filter(F.lower("kind") == kind.lower())
    if accessibility is not None:
        rows = rows.filter(F.col("accessibility") == accessibility.lower())
    rows = in_project(ix, rows, project_id)
    if exclude_test_projects:
        rows = rows.join(ix.projects.filter("is_test_project").select(F.col("id").alias("project_id")), "project_id", "left_anti")
    used = ix.refs.select(F.col("symbol_id").alias("id"))
    return project_names(ix, rows.join(used, "id", "left_anti")).orderBy("file_path", "line_start", "id")


def namespace_tree(ix: Index, namespace_prefix: str | None = None, project_id: str | None = None, depth: int = 1) -> DataFrame:
    """(namespace, type_count): namespaces up to depth below a prefix, with the types in and under each.

    Each type counts for every child that its namespace is or lies under, so it is exploded
    to the ancestors of its namespace and joined to the children.
    """
    types = in_project(ix, ix.symbols.filter(F.col("kind").isin(*TYPE_KINDS)), project_id)
    spaces = types.select(namespace_of("fqn").alias("ns")).filter(F.col("ns").isNotNull())
    level = 0
    if namespace_prefix:
        level = namespace_prefix.count(".") + 1
        spaces = spaces.filter(F.col("ns").startswith(namespace_prefix + "."))
    parts = F.split("ns", r"\.")
    counted = spaces.groupBy("ns").agg(F.count("*").alias("n"))
    head = lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")
    children = counted.select(head(F.least(F.size(parts), F.lit(level + depth))).alias("namespace")).distinct()
    above = counted.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"), "n").select(F.array_join(F.expr("slice(parts, 1, k)"), ".").alias("namespace"), "n")
    return above.groupBy("namespace").agg(F.sum("n").alias("type_count")).join(children, "namespace", "left_semi").orderBy("namespace")


def namespace_symbols(ix: Index, namespace: str, project_id: str | None = None) -> DataFrame:
    """Symbols directly in a namespace, of any kind."""
    return in_project(ix, ix.symbols.filter(namespace_of("fqn") == namespace), project_id)


def source_context(df: DataFrame, text_col: str, line: str | int, context_lines: int = 5) -> DataFrame:
    """df's columns but the text, with (line, text) of the lines around a line: one row each, counted from 1."""
    at = F.col(line) if isinstance(line, str) else F.lit(line)
    others = [c for c in df.columns if c != text_col]
    rows = df.select(*others, at.alias("__at"), F.posexplode(lines_of(F.col(text_col))).alias("__pos", "__line"))
    return rows.filter((F.col("__pos") >= F.col("__at") - 1 - context_lines) & (F.col("__pos") < F.col("__at") + context_lines)).select(*others, (F.col("__pos") + 1).alias("line"), F.col("__line").alias("text"))


def resolve_citations(ix: Index, answers: DataFrame, text_col: str) -> DataFrame:
    """Symbols that texts cite by qualified name: (citation, and the first symbol of that name)."""
    cited = answers.select(F.explode(citations(text_col)).alias("citation")).distinct()
    first = ix.symbols.groupBy("fqn").agg(F.min_by(F.struct("id", "file_path", "line_start", "last_indexed_at"), "id").alias("s"))
    return cited.join(first, F.col("citation") == F.col("fqn")).select("citation", "s.*")
