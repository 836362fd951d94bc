"""One query an operator over the index that is derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..catalog import Index
from ..operators import maintenance
from ..operators.intervals import counts_inside
from ..operators.scope import project_names
from ..operators.search import match_terms
from ..sources.dependencies import classify_dependencies, mark_test_projects
from ..sources.files import assign_submodules, extract_comments, submodules
from ..sources.star import from_star, star_view
from ..sources.textindex import TextIndex
from ..sources.versions import publish, read_current, scratch_folder
from ..streaming import incremental, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Index], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(from_star(spark, sf_dir))
    return f


def table_query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(ix: Index, ids: DataFrame) -> str:
    """Name of the symbol that a one-row table (id) holds."""
    row = ix.symbols.join(ids, "id").select("fqn").head()
    return row.fqn if row else ""


def _busiest(ix: Index, edges: DataFrame, column: str) -> str:
    """Name of the symbol with most edges, of the lowest id."""
    return _name(ix, edges.groupBy(F.col(column).alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id"))


def _project(ix: Index, ids: DataFrame) -> str:
    row = ix.projects.join(ids, "id").select("canonical_id").head()
    return row.canonical_id if row else ""


def _big_project(ix: Index) -> str:
    return _project(ix, ix.symbols.groupBy(F.col("project_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id"))


SYMBOL = ("id", "fqn", "kind", "accessibility", "file_path", "line_start")


@query
def find_unreferenced(ix):
    return op.find_unreferenced(ix).select(*SYMBOL, "project")


@query
def find_unreferenced_filtered(ix):
    return op.find_unreferenced(ix, kind="method", accessibility="public", exclude_test_projects=False).select(*SYMBOL, "project")


@query
def index_status(ix):
    return op.index_status(ix).select("canonical_id", F.col("is_test_project").cast("int").alias("is_test_project"), "last_indexed_at", "symbol_count", "reference_count")


@query
def freshness(ix):
    return op.freshness(ix.symbols)


@query
def find_symbol_exact(ix):
    return op.find_symbol(ix, _busiest(ix, ix.refs, "symbol_id")).select(*SYMBOL, "project")


@query
def find_symbol_fuzzy(ix):
    return op.find_symbol(ix, "M1 OR M2 OR Type1", fuzzy=True).select("id", "fqn", "project", F.round("score", 6).alias("score"))


@query
def file_symbols(ix):
    path = ix.symbols.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").head().file_path
    return op.file_symbols(ix, path).select(*SYMBOL)


@query
def type_members(ix):
    return op.type_members(ix, ix.symbols.filter("kind = 'class'").orderBy("id").head().fqn).select("id", "fqn", "kind", F.col("inherited").cast("int").alias("inherited"))


@query
def type_members_inherited(ix):
    derived = ix.relationships.filter("kind = 'inherits'").agg(F.min("from_symbol_id").alias("id"))
    return op.type_members(ix, _name(ix, derived), include_inherited=True).select("id", "fqn", "kind", F.col("inherited").cast("int").alias("inherited"))


REF = ("symbol_id", "project", "file_path", "line", "reference_kind", "access_kind")


@query
def find_references_flat(ix):
    return op.find_references(ix, _busiest(ix, ix.refs, "symbol_id")).select(*REF)


@query
def find_references_access_filter(ix):
    return op.find_references(ix, _busiest(ix, ix.refs, "symbol_id"), access_kind="Read").select(*REF)


@query
def find_references_scope_project(ix):
    name = _busiest(ix, ix.refs, "symbol_id")
    first = op.find_references(ix, name).agg(F.min("in_project_id").alias("id"))
    return op.find_references(ix, name, scope=f"project:{_project(ix, first)}").select(*REF)


@query
def find_references_scope_solution(ix):
    return op.find_references(ix, _busiest(ix, ix.refs, "symbol_id"), scope="solution:org1.sln").select(*REF)


@query
def find_references_include_projects(ix):
    names = [r.canonical_id for r in ix.projects.orderBy("id").limit(12).collect()]
    return op.find_references(ix, _busiest(ix, ix.refs, "symbol_id"), include_projects=", ".join([*names, "unknown"])).select(*REF)


@query
def find_references_grouped_counts(ix):
    refs = project_names(ix, ix.refs, "in_project_id")
    return op.group_counts(refs, ["project", "kind"]).select("project", "reference_kind", F.col("level").cast("long").alias("level"), "count")


@query
def find_references_nested(ix):
    groups = op.grouped_references(op.find_references(ix, _busiest(ix, ix.refs, "symbol_id")), ["kind", "file"])
    inner = groups.select("group_key", F.explode("items").alias("g"), F.col("count").alias("total"))
    return inner.select(F.col("group_key").alias("kind"), "total", F.col("g.group_key").alias("file"), F.col("g.count").alias("count"), F.size("g.items").cast("long").alias("items"))


@query
def implementors(ix):
    top = ix.relationships.filter("kind = 'implements'").groupBy(F.col("to_symbol_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")
    return op.implementors(ix, _name(ix, top))


@query
def type_dependents(ix):
    rows = op.type_dependents(ix, _busiest(ix, ix.relationships.filter("kind <> 'parameterof'"), "to_symbol_id"))
    return rows.groupBy("dependent", "dependency").agg(F.count("*").alias("count"), F.count("via_member").alias("members"), F.min("line").cast("long").alias("first_line"))


@query
def trace_origins(ix):
    rows = op.trace_origins(ix, _busiest(ix, ix.call_graph, "callee_symbol_id"))
    return rows.select("parameter_name", F.col("ordinal").cast("long").alias("ordinal"), "count", F.explode("origins").alias("o")).select("parameter_name", "ordinal", "count", "o.caller", F.col("o.call_site_line").cast("long").alias("line"), "o.argument_expression", "o.argument_kind")


@query
def trace_origins_ordinal(ix):
    return op.trace_origins(ix, _busiest(ix, ix.call_graph, "callee_symbol_id"), "1").select("parameter_name", "count")


@query
def trace_destinations(ix):
    return op.trace_destinations(ix, _busiest(ix, ix.call_graph, "callee_symbol_id")).select("call_graph_id", "caller", F.col("call_site_line").cast("long").alias("line"), "destination_kind", "destination_variable")


def _calls(ix, direction, depth):
    name = _busiest(ix, ix.call_graph, "caller_symbol_id" if direction == "callees" else "callee_symbol_id")
    return op.call_hierarchy(ix, name, direction, depth, places=False).select("edge_id", "symbol_id", "fqn", F.col("depth").cast("long").alias("depth"))


@query
def call_hierarchy_callees(ix):
    return _calls(ix, "callees", 5)


@query
def call_hierarchy_callers(ix):
    return _calls(ix, "callers", 5)


@query
def call_hierarchy_callees_depth1(ix):
    return _calls(ix, "callees", 1)


@query
def call_reach_all(ix):
    """How many symbols each type's constructors reach within three calls, all roots at once."""
    roots = ix.symbols.filter("kind = 'constructor'").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return op.call_reach(ix, roots, "callees", 3)


@query
def type_hierarchy_up(ix):
    last = ix.relationships.filter("kind = 'inherits'").agg(F.max("from_symbol_id").alias("id"))
    return op.type_hierarchy(ix, _name(ix, last), "up").select("symbol_id", "fqn", F.col("depth").cast("long").alias("depth"))


@query
def type_hierarchy_down(ix):
    first = ix.relationships.filter("kind = 'inherits'").agg(F.min("to_symbol_id").alias("id"))
    return op.type_hierarchy(ix, _name(ix, first), "down").select("symbol_id", "fqn", F.col("depth").cast("long").alias("depth"))


@query
def project_deps_direct(ix):
    return op.project_dependencies(ix, _project(ix, ix.project_dependencies.groupBy(F.col("consumer_project_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id"))).withColumn("depth", F.col("depth").cast("long"))


@query
def project_deps_transitive(ix):
    last = ix.project_dependencies.agg(F.max("consumer_project_id").alias("id"))
    return op.project_dependencies(ix, _project(ix, last), transitive=True).withColumn("depth", F.col("depth").cast("long"))


@query
def relationship_levels(ix):
    """Levels and cycles of all symbols by their relationships."""
    return op.dependency_levels(ix.relationships.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst")))


@query
def dependency_levels(ix):
    """Levels of projects by their dependencies, in which order they can be built."""
    return op.dependency_levels(ix.project_dependencies.select(F.col("consumer_project_id").alias("src"), F.col("dependency_project_id").alias("dst")))


@query
def dependent_files(ix):
    return op.dependent_files(ix, ix.symbols.filter("id <= 10").select("file_path"))


@query
def api_surface(ix):
    return op.api_surface(ix, _big_project(ix)).select("id", "fqn", "accessibility")


@query
def api_surface_diff(ix):
    return op.diff_surfaces(ix.snapshots.filter("git_commit = 'c1'"), ix.snapshots.filter("git_commit = 'c2'"))


@query
def api_overall(ix):
    return op.overall_change(op.surface_changes(ix, _big_project(ix), "c1", "c2"))


@query
def latest_snapshot(ix):
    return op.latest_snapshot(ix).groupBy("project_id", "git_commit").agg(F.count("*").alias("count"))


@query
def previous_commit(ix):
    return op.previous_commit(ix, _big_project(ix), "c2")


@query
def snapshot_capture(ix):
    return op.capture_snapshot(ix, "c2", 3000).groupBy("project_id", "git_commit", "captured_at").agg(F.count("*").alias("count"))


@query
def impact_consumers(ix):
    counts = ix.project_dependencies.groupBy(F.col("dependency_project_id").alias("project_id")).count()
    top = ix.symbols.filter("kind = 'method' and accessibility = 'public'").join(counts, "project_id").orderBy(F.desc("count"), "id").limit(1).select("id")
    rows = op.impact(ix, _name(ix, top))
    return rows.select("consumer_project_id", "project", "reference_count", "submodule_pinned_commit", F.col("pin_includes_current").cast("int").alias("pin_includes_current"), F.col("is_api_surface").cast("int").alias("is_api_surface"), "change_classification")


@query
def find_by_attribute(ix):
    return op.find_by_attribute(ix, "global::NUnit.Framework.TestAttribute").select(*SYMBOL)


@query
def find_by_attribute_scope(ix):
    return op.find_by_attribute(ix, "global::Xunit.FactAttribute", scope="solution:org2.sln").select(*SYMBOL)


@query
def find_by_signature(ix):
    return op.find_by_signature(ix, return_type="Task", parameter_type="string", parameter_count=3, max_results=400).select("id", "fqn", "signature")


@query
def find_by_signature_strict(ix):
    return op.find_by_signature(ix, return_type="void", parameter_count=2, max_results=50, strict_topk=True).select("id", "fqn", "signature")


@query
def find_tests_all(ix):
    return op.find_tests(ix, max_results=None).select("id", "fqn", "framework")


@query
def find_tests_framework(ix):
    return op.find_tests(ix, framework="nunit", max_results=None).select("id", "fqn", "framework")


def _tested(ix):
    tests = ix.symbols.filter(fn.attribute_list("attributes").isNotNull()).select("file_path", "line_start", "line_end")
    inside = F.col("line").between(F.col("line_start"), F.col("line_end"))
    return ix.refs.join(tests, "file_path").filter(inside).agg(F.min("symbol_id").alias("id"))


@query
def find_tests_for_symbol(ix):
    return op.find_tests(ix, _name(ix, _tested(ix))).select("id", "fqn", "framework")


@query
def find_tests_fallback(ix):
    return op.find_tests(ix, ix.symbols.filter("display_name = 'Type1'").orderBy("id").head().fqn, max_results=500).select("id", "fqn", "framework")


@query
def test_references(ix):
    """Every reference that lies in a test method: point in interval, with equality on the file."""
    tests = op.find_tests(ix, max_results=None)
    return counts_inside(tests, ix.refs, ["file_path"]).select(F.col("id").alias("test_id"), "count")


@query
def find_comments_tag(ix):
    return op.find_comments(ix, tag="todo", max_results=40).select("id", "file_path", "line", "tag", "text", "enclosing_symbol")


@query
def find_comments_search(ix):
    return op.find_comments(ix, search="%B", max_results=30, project_id=_big_project(ix)).select("id", "file_path", "line", "tag")


@query
def find_comments_in_symbol(ix):
    some = ix.comments.filter("enclosing_symbol_id is not null").agg(F.min("enclosing_symbol_id").alias("id"))
    return op.find_comments(ix, in_symbol=_name(ix, some)).select("id", "line", "tag", "enclosing_symbol")


@query
def comment_enclosing_symbol(ix):
    return op.enclosing_symbols(ix, ix.comments).select("id", "line", "enclosing_symbol_id")


@query
def namespace_tree(ix):
    return op.namespace_tree(ix)


@query
def namespace_tree_depth2(ix):
    return op.namespace_tree(ix, "global::Org1", depth=2).unionByName(op.namespace_tree(ix, depth=3))


@query
def namespace_symbols(ix):
    return op.namespace_symbols(ix, ix.symbols.filter("kind = 'class'").orderBy("id").select(fn.namespace_of("fqn").alias("ns")).head().ns).select("id", "fqn", "kind")


@query
def bm25_symbols(ix):
    return op.semantic_search(ix, "widget economy", max_results=20).select("id", F.round("score", 6).alias("score"))


@table_query
def bm25_documents(spark, sf_dir):
    """The best 25 of all documents for two words, weighed over all of them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return match_terms(docs, "doc_id", ("text",), "the with", 25).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@table_query
def bm25_indexed(spark, sf_dir):
    """The same from a stored index of all documents, which reads the blocks that may hold the best only."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = TextIndex.build(docs, "doc_id", ("text",), scratch_folder(spark, "text")).search("the with", 25)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@table_query
def bm25_indexed_update(spark, sf_dir):
    """The same after an update: a tenth of the documents had other texts, and some are gone."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    tenth = F.col("doc_id") % 10 == 0
    old = docs.withColumn("text", F.when(tenth, F.lit("the with the")).otherwise(F.col("text"))).unionByName(docs.filter(tenth).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("with the").alias("text")))
    index = TextIndex.build(old, "doc_id", ("text",), scratch_folder(spark, "text"))
    index = index.update(docs.filter(tenth), "doc_id", old.filter("doc_id < 0").select(F.col("doc_id").alias("id")))
    return index.search("the with", 25).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@table_query
def bm25_expression(spark, sf_dir):
    """A phrase, a prefix, a group of near words and an exclusion, over all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_terms(docs, "doc_id", ("text",), '("of the" AND ^th*) OR (NEAR(with was, 3) NOT that)', 200)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def bm25_kind_filter(ix):
    return op.semantic_search(ix, "M1 OR Type1 OR Type2", kind="class").select("id", "kind", F.round("score", 6).alias("score"))


@table_query
def debounce_sessions(spark, sf_dir):
    changes = _read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("root"), F.concat(F.lit("/src/"), F.col("event_type"), F.lit(".cs")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    s = stream.debounced(changes, "30 minutes")
    return s.select("root", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.array_join("paths", ",").alias("paths"))


def _listing(ix):
    """A later listing of the files: every 7th changed, every 11th gone, some new."""
    f = ix.file_index
    kept = f.filter("id % 11 <> 0").select("project_id", "file_path", F.when(F.col("id") % 7 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return kept.unionByName(f.filter("id % 13 = 0").select("project_id", F.concat("file_path", F.lit(".new")).alias("file_path"), "content_hash"))


@query
def changed_files(ix):
    return incremental.changed_files(ix.file_index, _listing(ix)).select("project_id", "file_path", "change")


@query
def signature_changed(ix):
    hashed = ix.symbols.withColumn("signature_hash", fn.signature_hash("signature", "fqn"))
    new = hashed.withColumn("signature_hash", F.when(F.col("id") % 17 == 0, F.lit("other")).otherwise(F.col("signature_hash")))
    return incremental.signature_changes(hashed, new).select("project_id", "fqn", "file_path")


@query
def upsert_last_wins(ix):
    rows = ix.file_index.filter("id % 5 = 0").select("id", "project_id", "file_path", F.lit("old").alias("content_hash"), F.lit(1).cast("long").alias("last_indexed_at"))
    rows = rows.unionByName(rows.withColumn("content_hash", F.lit("new")).withColumn("last_indexed_at", F.lit(2).cast("long")).withColumn("id", F.col("id") + 10**9))
    return maintenance.upsert(ix.file_index, rows, ("project_id", "file_path"), "last_indexed_at").select("id", "project_id", "file_path", "content_hash")


@query
def insert_or_ignore(ix):
    rows = ix.solution_projects.withColumn("solution_id", F.col("solution_id") % 3 + 1)
    return maintenance.insert_ignore(ix.solution_projects, rows, ("solution_id", "project_id"))


def _left(ix):
    return maintenance.cascade_delete(ix, symbols=ix.symbols.filter("id % 3 = 0").select("id"))


@query
def cascade_delete(ix):
    after = _left(ix)
    parts = [after[t].select(F.lit(t).alias("table_name"), F.lit(1).alias("one")) for t in ("symbols", "refs", "relationships", "call_graph", "argument_flow", "return_flow", "comments")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").agg(F.count("*").alias("rows"))


@query
def set_null_comments(ix):
    return _left(ix).comments.select("id", "enclosing_symbol_id")


@query
def cascade_files(ix):
    changed = ix.symbols.filter("id % 97 = 0").select("file_path")
    return incremental.cascade_items(ix, changed)


@table_query
def canonical_ids(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    url = F.concat(F.lit("git@Example.COM:org"), F.col("n_regionkey"), F.lit(".git"))
    return n.select("n_nationkey", fn.canonical_id(url, F.concat(F.lit("src/"), "n_name")).alias("canonical_id"))


@table_query
def url_normalise(spark, sf_dir):
    """Address forms of the pages, normalised."""
    p = _read(spark, sf_dir, "pages").filter("url is not null")
    forms = F.array(F.col("url"), F.concat(F.lit("ssh://git@GitHub.com/"), F.col("page_id"), F.lit(".GIT")), F.concat(F.lit("https://user:pw@GitHub.com:8443/Org/"), F.col("page_id"), F.lit("/?q=1")))
    return p.select("page_id", F.posexplode(forms).alias("form", "raw")).select("page_id", F.col("form").cast("long").alias("form"), fn.normalize_url("raw").alias("url"))


@table_query
def strip_xml(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(fn.strip_xml("html")).alias("digest"))


@table_query
def source_context(spark, sf_dir):
    return op.source_context(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 3, 2).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query
def count_parameters(ix):
    return ix.symbols.select("id", fn.count_parameters("signature").cast("long").alias("parameters"))


@query
def name_parts(ix):
    return ix.symbols.select("id", fn.namespace_of("fqn").alias("namespace"), fn.simple_name("fqn").alias("simple"), fn.containing_type("fqn").alias("holder"), fn.file_name("file_path", False).alias("stem"), fn.accessibility_rank("accessibility").cast("long").alias("rank"))


def source_query(f: Callable[[Index, DataFrame], DataFrame]):
    """A query of an index and the texts of its files."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(from_star(spark, sf_dir), star_view(spark, sf_dir, "file_texts"))
    return f


def _context(rows, *keys):
    """One row a line of source_context."""
    return rows.select(*keys, F.explode("source_context.lines").alias("l")).select(*keys, F.col("l.line_number").cast("long").alias("line_number"), F.col("l.content").alias("content"))


@source_query
def find_symbol_source(ix, files):
    name = ix.symbols.filter("kind = 'class'").orderBy("id").head().fqn
    return _context(op.find_symbol(ix, name, source=files), "id", "project", "line_end")


@source_query
def find_references_source(ix, files):
    rows = op.find_references(ix, _busiest(ix, ix.refs, "symbol_id"), source=files)
    return _context(rows, "file_path", "line", "reference_kind", "access_kind")


@source_query
def call_hierarchy_source(ix, files):
    rows = op.call_hierarchy(ix, _busiest(ix, ix.call_graph, "callee_symbol_id"), "callers", 2, source=files)
    return _context(rows, "edge_id")


@table_query
def test_projects(spark, sf_dir):
    """Projects whose references name a test framework."""
    projects = star_view(spark, sf_dir, "projects").select("id", "canonical_id")
    return mark_test_projects(projects, star_view(spark, sf_dir, "assemblies")).select("id", "canonical_id", F.col("is_test_project").cast("int").alias("is_test_project"))


@table_query
def dependency_kinds(spark, sf_dir):
    """References of projects as project, submodule or package dependencies; each project names those of the table of dependencies."""
    projects = star_view(spark, sf_dir, "projects").select("id", F.col("repo_relative_path").alias("file_path"))
    named = star_view(spark, sf_dir, "project_dependencies").select(F.col("consumer_project_id").alias("project_id"), F.col("dependency_project_id").alias("id"))
    modules = star_view(spark, sf_dir, "projects").filter("n_regionkey = 1").select(F.concat(F.lit("SRC\\"), F.upper("assembly_name")).alias("path"), F.concat(F.lit("c0ffee"), "id").alias("commit"))
    return classify_dependencies(projects, named.join(projects, "id").select("project_id", "file_path"), modules, star_view(spark, sf_dir, "assemblies"))


@table_query
def submodule_report(spark, sf_dir):
    """Folders and commits of a status report with a line for each nation, and lines that are none."""
    n = _read(spark, sf_dir, "nation")
    mark = F.element_at(F.array(*map(F.lit, (" ", "+", "-", "?"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    line = F.concat(mark, F.md5("n_name"), F.lit(" lib/"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, " (heads/main)").otherwise(""))
    return submodules(n.select(line.alias("line")))


@query
def file_submodules(ix):
    """Files of symbols and the submodule whose folder holds them."""
    modules = ix.projects.filter("id % 2 = 0").select(F.concat(F.lit("SRC/"), F.upper("assembly_name"), F.lit("/")).alias("path"))
    return assign_submodules(ix.symbols.select("file_path").distinct(), modules)


@table_query
def comment_extract(spark, sf_dir):
    """Tagged comments of a source text for each part: in strings, on one line, over lines, twice."""
    p = _read(spark, sf_dir, "part")
    text = F.concat(F.lit('var s = "// TODO no"; // plain\r\n// todo: '), "p_name", F.lit("\n/* FIXME "), "p_type", F.lit(" */ x();\n\n// todo: "), "p_name", F.lit("\n/*\n HACK: a\n b*/ // NOTE "), "p_brand")
    rows = extract_comments(p.select(F.col("p_partkey").cast("string").alias("file_path"), text.alias("text")))
    return rows.select("file_path", F.col("line").cast("long").alias("line"), "tag", F.regexp_replace("text", r"\s+", " ").alias("text"))


@table_query
def context_snippets(spark, sf_dir):
    """Text around the span from a tenth to a fifth of each document."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n"))
    return d.select("doc_id", fn.snippet("text", F.floor(F.col("n") / 10).cast("int"), F.floor(F.col("n") / 5).cast("int")).alias("snippet"))


def _answers(ix):
    """A text for each symbol, that cites it twice, and another."""
    return ix.symbols.select("id", F.concat(F.lit("See `"), "fqn", F.lit("`; "), "fqn", F.lit(", not global::Org0.None or global::")).alias("text"))


@query
def cited_names(ix):
    return _answers(ix).select("id", F.explode(fn.citations("text")).alias("name"))


@query
def cited_symbols(ix):
    return op.resolve_citations(ix, _answers(ix), "text").select("citation", "id", "file_path")


@table_query
def profile_names(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    forms = F.explode(F.array("p_name", "p_brand", "p_type", F.concat("p_type", F.lit("_"), "p_size"), F.lit(""))).alias("name")
    return p.select(forms).groupBy("name").agg(F.count("*").alias("count")).select("name", "count", fn.valid_profile("name").cast("int").alias("valid"))


@table_query
def target_frameworks(spark, sf_dir):
    """The framework of a project file for each part: one, several or none."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    inner = F.when(k == 0, F.concat(F.lit("<TargetFramework> net"), "p_size", F.lit(".0 </TargetFramework>"))).when(k == 1, F.concat(F.lit("<TargetFrameworks>net"), "p_size", F.lit(".0;net1.0</TargetFrameworks>"))).otherwise("")
    xml = F.concat(F.lit("<Project><PropertyGroup>"), inner, F.lit("</PropertyGroup></Project>"))
    return p.select("p_partkey", fn.target_framework(xml).alias("framework"))


@table_query
def generated_files(spark, sf_dir):
    """Paths that count as generated, and those in folders that aren't watched."""
    p = _read(spark, sf_dir, "part")
    ends = ("a/b.cs", "a/b.G.cs", "a/B.Designer.cs", "a/obj/b.cs", "a\\OBJ\\b.cs", "a/bin/b.cs", "a/.git/x", "object/b.cs")
    rows = p.select("p_partkey", F.explode(F.array(*[F.concat("p_brand", F.lit("/" + e)) for e in ends])).alias("path"))
    return rows.select("p_partkey", "path", fn.is_generated("path").cast("int").alias("generated"), fn.is_ignored("path").cast("int").alias("ignored"))


@query
def resolved_names(ix):
    """Relationships written by name, some to names that nothing has."""
    name = F.when(F.col("to_symbol_id") % 7 == 0, F.concat("fqn", F.lit("?"))).otherwise(F.col("fqn")).alias("target")
    edges = ix.relationships.join(ix.symbols.select(F.col("id").alias("to_symbol_id"), "fqn"), "to_symbol_id").select("from_symbol_id", "kind", name)
    return maintenance.resolve_names(edges, ix.symbols, "target", "to_symbol_id").select("from_symbol_id", "kind", "to_symbol_id")


@query
def append_rows(ix):
    more = ix.relationships.withColumn("kind", F.concat("kind", F.lit("2")))
    return maintenance.append(ix.relationships, more).groupBy("kind").agg(F.count("*").alias("count"))


def _queue(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "immediate").otherwise("background").alias("priority"))


@table_query
def queue_head(spark, sf_dir):
    """The next 100 items of a queue."""
    return incremental.work_order(_queue(spark, sf_dir)).limit(100)


@table_query
def service_report(spark, sf_dir):
    return op.service_status(from_star(spark, sf_dir), _queue(spark, sf_dir), "indexing", "extract").select("state", "queued_files", "background_tasks", "last_indexed_at", "project_count", "phase", "indexing_started_at", "elapsed_ms")


def _fifth_changed(ix):
    """The index after a fifth of the files has changed: a third of their symbols is gone, and references at later lines."""
    files = ix.symbols.filter("kind in ('class', 'interface') and id % 5 = 1").select("project_id", "file_path")
    changes = files.withColumn("content_hash", F.lit("new")).withColumn("change", F.lit("changed"))
    stay = ix.symbols.join(files, ["project_id", "file_path"], "left_semi").filter("id % 3 <> 0")
    seen = ix.refs.join(files.withColumnRenamed("project_id", "in_project_id"), ["in_project_id", "file_path"], "left_semi").filter("line <= 100 and symbol_id % 3 <> 0")
    return incremental.apply_changes(ix, changes, {"symbols": stay, "refs": seen.select(*ix.refs.columns)})


def _counts(after):
    names = ("symbols", "refs", "relationships", "call_graph", "comments")
    rows = [after[t].select(F.lit(t).alias("table_name")) for t in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("table_name").agg(F.count("*").alias("rows"))


@query
def apply_changes_counts(ix):
    """Rows of each table after changes."""
    return _counts(_fifth_changed(ix))


@query
def published_changes_counts(ix):
    """The same from disk: a version is published, then read, changed and published again, and what is current is read."""
    root = scratch_folder(ix.spark, "index")
    publish(ix, root)
    publish(_fifth_changed(read_current(ix.spark, root)), root)
    return _counts(read_current(ix.spark, root))
