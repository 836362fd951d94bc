"""The operators on a small seeded index, with exact results."""

import pytest
from pyspark.sql import functions as F

from trellis import operators as op
from trellis.catalog import Index
from trellis.schemas import TABLES

A, B = "proj_alpha_123456", "proj_beta_7890ab"
XU, NU = '["global::Xunit.FactAttribute"]', '["global::NUnit.Framework.TestAttribute"]'


def make(spark, table, columns, rows):
    kinds = {f.name: f.dataType.simpleString() for f in TABLES[table]}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in columns.split()))


@pytest.fixture(scope="module")
def ix(spark):
    s = "global::Alpha.BaseService"
    symbols = [
        (1, 1, s, "BaseService", "class", "public", None, "/a/Base.cs", 1, 60, None),
        (2, 1, "global::Alpha.DerivedService", "DerivedService", "class", "public", None, "/a/Derived.cs", 1, 20, None),
        (3, 1, "global::Alpha.IProcessor", "IProcessor", "interface", "public", None, "/a/IProcessor.cs", 1, 9, None),
        (4, 1, f"{s}.Init()", "Init", "method", "public", "void Init()", "/a/Base.cs", 5, 8, None),
        (5, 1, f"{s}.Process(string)", "Process", "method", "public", "void Process(string input)", "/a/Base.cs", 10, 15, None),
        (6, 1, f"{s}.Transform(string, int)", "Transform", "method", "public", "string Transform(string data, int count)", "/a/Base.cs", 17, 20, None),
        (7, 1, f"{s}.LoadAsync()", "LoadAsync", "method", "public", "Task LoadAsync()", "/a/Base.cs", 22, 25, None),
        (8, 1, f"{s}.Name", "Name", "property", "public", "string Name", "/a/Base.cs", 27, 27, None),
        (9, 1, f"{s}.Merge(string, Dictionary<string, int>, bool)", "Merge", "method", "protected", "void Merge(string key, Dictionary<string, int> values, bool overwrite)", "/a/Base.cs", 29, 33, None),
        (10, 1, "global::Alpha.BaseServiceTests.Process_ReturnsExpected()", "Process_ReturnsExpected", "method", "public", "void Process_ReturnsExpected()", "/a/Tests.cs", 5, 9, XU),
        (11, 1, "global::Alpha.BaseServiceTests.Init_Works()", "Init_Works", "method", "public", "void Init_Works()", "/a/Tests.cs", 11, 15, XU),
        (12, 1, "global::Alpha.NUnitTests.SomeTest()", "SomeTest", "method", "public", "void SomeTest()", "/a/NTests.cs", 5, 9, NU),
        (13, 1, "global::Alpha.Orchestrator.Execute()", "Execute", "method", "public", "void Execute()", "/a/Orchestrator.cs", 5, 9, None),
        (14, 2, "global::Beta.Consumer", "Consumer", "class", "public", None, "/b/Consumer.cs", 1, 40, "not json"),
        (15, 2, "global::Beta.Consumer.Run()", "Run", "method", "public", "void Run()", "/b/Consumer.cs", 5, 12, None),
        (16, 2, "global::Beta.Consumer.GetService()", "GetService", "method", "public", "BaseService GetService()", "/b/Consumer.cs", 14, 18, None),
        (17, 2, "global::Beta.Consumer.UseService(BaseService)", "UseService", "method", "public", "void UseService(BaseService service)", "/b/Consumer.cs", 20, 24, None),
    ]
    t = {
        "projects": make(spark, "projects", "id canonical_id is_test_project last_indexed_at", [(1, A, False, 100), (2, B, False, 200)]),
        "symbols": make(spark, "symbols", "id project_id fqn display_name kind accessibility signature file_path line_start line_end attributes", symbols),
        "relationships": make(spark, "relationships", "id from_symbol_id to_symbol_id kind", [(1, 2, 1, "inherits"), (2, 2, 3, "implements")]),
        "refs": make(spark, "refs", "id symbol_id in_project_id file_path line reference_kind access_kind", [
            (1, 5, 1, "/a/Caller.cs", 10, "invocation", "read"), (2, 5, 2, "/b/Consumer.cs", 8, "invocation", "read"), (3, 5, 1, "/a/Writer.cs", 22, "invocation", "write"),
            (4, 4, 1, "/a/Caller.cs", 12, "invocation", None), (5, 1, 2, "/b/Consumer.cs", 16, "typeref", None), (6, 1, 2, "/b/Consumer.cs", 21, "typeref", None)]),
        "comments": make(spark, "comments", "id project_id file_path line tag text", [(1, 1, "/a/Base.cs", 11, "TODO", "add retry"), (2, 1, "/a/Base.cs", 18, "HACK", "slow"), (3, 1, "/a/Derived.cs", 3, "FIXME", "null"), (4, 2, "/b/Consumer.cs", 6, "TODO", "inject")]),
        "call_graph": make(spark, "call_graph", "id caller_symbol_id callee_symbol_id call_site_file call_site_line", [(1, 15, 5, "/b/Consumer.cs", 8), (2, 13, 5, "/a/Orchestrator.cs", 7)]),
        "argument_flow": make(spark, "argument_flow", "id call_graph_id parameter_ordinal parameter_name argument_expression argument_kind", [(1, 1, 0, "input", "this.Name", "property_access"), (2, 2, 0, "input", '"x"', "literal")]),
        "return_flow": make(spark, "return_flow", "id call_graph_id destination_kind destination_variable", [(1, 1, "assignment", "r"), (2, 2, "discard", None)]),
        "project_dependencies": make(spark, "project_dependencies", "id consumer_project_id dependency_project_id reference_kind", [(1, 2, 1, "project_ref")]),
    }
    return Index(spark, t)


P = "global::Alpha.BaseService.Process(string)"


def names(df, column="display_name"):
    return sorted(r[column] for r in df.collect())


def test_references(ix):
    refs = op.find_references(ix, P)
    assert refs.count() == 3
    assert {(r.group_key, r["count"]) for r in op.grouped_references(refs, ["project"]).collect()} == {(A, 2), (B, 1)}
    nested = op.grouped_references(refs, ["kind", "project", "colour"]).collect()
    assert [(r.group_key, r["count"], [(g.group_key, g["count"], [h.group_key for h in g["items"]]) for g in r["items"]]) for r in nested] == [("invocation", 3, [(A, 2, ["unknown"]), (B, 1, ["unknown"])])]
    assert op.find_references(ix, P, access_kind="write").count() == 1
    assert op.find_references(ix, P, access_kind="odd").count() == 3
    assert op.find_references(ix, P, include_projects="no such").count() == 0
    assert op.find_references(ix, P, scope=f"project:{B}").count() == 1
    assert op.find_references(ix, P, scope="project:unknown").count() == 3
    assert op.find_references(ix, P, scope="file:/a/Writer.cs").count() == 1
    assert op.find_references(ix, "nothing").count() == 0


def test_unreferenced_and_status(ix):
    assert op.find_unreferenced(ix).count() == 14
    assert [(r.canonical_id, r.symbol_count, r.reference_count) for r in op.index_status(ix).collect()] == [(B, 4, 3), (A, 13, 3)]


def test_signatures(ix):
    assert names(op.find_by_signature(ix, parameter_count=3)) == ["Merge"]
    assert names(op.find_by_signature(ix, parameter_type="string")) == ["Merge", "Process", "Transform"]
    assert names(op.find_by_signature(ix, return_type="Task")) == ["LoadAsync"]
    assert names(op.find_by_signature(ix, return_type="string", kind="property")) == ["Name"]
    assert op.find_by_signature(ix, parameter_count=0).count() == 8


def test_comments(ix):
    assert op.find_comments(ix).count() == 4
    assert op.find_comments(ix, tag="todo").count() == 2
    assert op.find_comments(ix, search="RETRY").count() == 1
    assert op.find_comments(ix, project_id=A).count() == 3
    inner = {r.id: r.enclosing_symbol_id for r in op.enclosing_symbols(ix, ix.comments).collect()}
    assert inner == {1: 5, 2: 6, 3: 2, 4: 15}


def test_tests(ix):
    assert op.find_tests(ix).count() == 3
    assert names(op.find_tests(ix, framework="nunit")) == ["SomeTest"]
    assert names(op.find_tests(ix, P)) == ["Process_ReturnsExpected"]
    assert names(op.find_tests(ix, "global::Alpha.BaseService.Init()")) == ["Init_Works"]
    assert op.find_tests(ix, "global::Beta.Consumer").count() == 0
    seen = make(ix.spark, "refs", "id symbol_id in_project_id file_path line reference_kind", [(9, 5, 1, "/a/Tests.cs", 12, "invocation")])
    with_use = ix.replace(refs=ix.refs.unionByName(seen, allowMissingColumns=True))
    assert names(op.find_tests(with_use, P)) == ["Init_Works"]


def test_types(ix):
    assert [(r.dependent, r.dependency) for r in op.type_dependents(ix, "global::Alpha.BaseService").collect()] == [("global::Alpha.DerivedService", "inherits")]
    assert names(op.implementors(ix, "global::Alpha.IProcessor"), "fqn") == ["global::Alpha.DerivedService"]
    assert [(r.direction, r.fqn, r.depth) for r in op.type_hierarchy(ix, "global::Alpha.DerivedService").collect()] == [("up", "global::Alpha.BaseService", 1)]
    assert op.type_hierarchy(ix, "global::Alpha.DerivedService", "sideways").count() == 0
    assert op.type_members(ix, "global::Alpha.BaseService").count() == 6
    assert op.type_members(ix, "global::Alpha.DerivedService", include_inherited=True).filter("inherited").count() == 6
    assert [(r.namespace, r.type_count) for r in op.namespace_tree(ix).collect()] == [("global::Alpha", 3), ("global::Beta", 1)]
    assert op.namespace_tree(ix, "global::Alpha").count() == 0
    assert op.namespace_symbols(ix, "global::Alpha").count() == 3


def test_calls_and_values(ix):
    assert {(r.fqn, r.depth) for r in op.call_hierarchy(ix, P, "callers").collect()} == {("global::Beta.Consumer.Run()", 1), ("global::Alpha.Orchestrator.Execute()", 1)}
    assert [(r.parameter_name, r.ordinal, r["count"]) for r in op.trace_origins(ix, P).collect()] == [("input", 0, 2)]
    assert op.trace_origins(ix, P, "7").count() == 0
    assert names(op.trace_destinations(ix, P), "destination_kind") == ["assignment", "discard"]


def test_impact_and_cascade(ix):
    row = op.impact(ix, P).collect()
    assert [(r.project, r.reference_count, r.is_api_surface, r.change_classification) for r in row] == [(B, 1, False, None)]
    snap = ix.replace(snapshots=op.capture_snapshot(ix, "c1", 1))
    assert snap.snapshots.count() == 13
    changed = snap.replace(symbols=snap.symbols.filter("id <> 4"))
    both = changed.replace(snapshots=op.capture_snapshot(changed, "c2", 2))
    assert [(r.is_api_surface, r.change_classification) for r in op.impact(both, P).collect()] == [(True, "breaking")]
    after = op.cascade_delete(ix, symbols=ix.symbols.filter("id = 5").select("id"))
    assert (after.symbols.count(), after.refs.count(), after.call_graph.count(), after.argument_flow.count()) == (16, 3, 0, 0)
    alone = op.cascade_delete(ix, projects=ix.projects.filter("id = 2").select("id"))
    assert (alone.symbols.count(), alone.refs.count(), alone.project_dependencies.count(), alone.comments.count()) == (13, 3, 0, 3)


def test_citations_and_attributes(ix):
    text = ix.spark.createDataFrame([("see global::Alpha.BaseService and global::No.Such(x)",)], "t string")
    assert names(op.resolve_citations(ix, text, "t"), "citation") == ["global::Alpha.BaseService"]
    assert op.find_by_attribute(ix, "global::Xunit.FactAttribute").count() == 2
    assert op.find_symbol(ix, P).select(F.col("project")).head().project == A
    assert op.find_symbol(ix, "base*", fuzzy=True).count() == 1
