"""What queries do once, however often they use it, and how much a task holds."""

from pyspark.sql import functions as F

from trellis import operators as op
from trellis.catalog import Index
from trellis.operators import graph
from trellis.sources import star, textindex, versions
from trellis.sources.star import from_star

SF = "/root/testdata/sf0.001"


def test_calls_are_derived_once(spark):
    """Walks read the written calls; before, each of five levels derived them from lineitem."""
    ix = from_star(spark, SF)
    assert not any("lineitem" in f for t in ("call_graph", "argument_flow", "return_flow") for f in ix[t].inputFiles())
    assert ix.call_graph.exceptAll(from_star(spark, SF).call_graph).isEmpty()


def test_calls_take_one_shuffle_of_lineitem(spark, monkeypatch):
    """The distinct and the join in the view use the rows as they were dealt."""
    monkeypatch.setattr(star, "WRITTEN", ())
    plan = star.star_view(spark, SF, "call_graph")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "caller_symbol_id" not in "".join(line for line in plan.splitlines() if "Exchange hash" in line)


def test_callees_are_walked_over_written_calls(spark):
    assert not any("lineitem" in f for f in op.call_hierarchy(from_star(spark, SF), "none", "callees", 2).inputFiles())


def test_a_walk_without_places_writes_no_files(spark, monkeypatch):
    """What nobody asked for is neither shuffled nor written at each level."""
    ix, written = from_star(spark, SF), []
    name = ix.symbols.join(ix.call_graph, F.col("caller_symbol_id") == ix.symbols["id"]).select("fqn").orderBy("fqn").first().fqn
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(df.columns) or write(df))
    bare = op.call_hierarchy(ix, name, "callees", 2, places=False)
    assert not any("call_site_file" in columns for columns in written)
    whole = op.call_hierarchy(ix, name, "callees", 2)
    assert any("call_site_file" in columns for columns in written)
    assert sorted(bare.collect()) == sorted(whole.select(*bare.columns).collect()) != []


def test_reach_counts_what_the_walk_lists(spark, monkeypatch):
    """Counted over pairs of symbols, with calls of symbols that aren't indexed, repeated calls and cycles; each task with few rows."""
    calls = [(1, 2, 1), (1, 2, 5), (2, 3, 1), (3, 1, 1), (2, 9, 1), (9, 4, 1), (9, 4, 2), (4, 5, 1), (7, 9, 3), (8, 8, 1), (8, 8, 2)]
    rows = [(c * 1000 + d * 10 + line, c, d, "f", line) for c, d, line in calls]
    graph_rows = spark.createDataFrame(rows, "id long, caller_symbol_id long, callee_symbol_id long, call_site_file string, call_site_line int")
    symbols = spark.createDataFrame([(k, f"S{k}") for k in range(1, 9)], "id long, fqn string")
    ix = Index(spark, {"call_graph": graph_rows, "symbols": symbols})
    roots = symbols.select(F.col("id").alias("root"), F.col("id").alias("node"))
    for tasks in (versions.TASK_ROWS, 2):
        monkeypatch.setattr(versions, "TASK_ROWS", tasks)
        monkeypatch.setattr(graph, "TASK_ROWS", tasks)
        for way in ("callees", "callers"):
            listed = graph.call_hierarchies(ix, roots, way, 3).groupBy("root").agg(F.countDistinct("symbol_id").alias("reached"), F.count("*").alias("edges"))
            assert sorted(listed.collect()) == sorted(op.call_reach(ix, roots, way, 3).collect()), (way, tasks)


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(versions, "TASK_ROWS", 10)
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    assert graph._dealt(spark.range(10).select("id"), "id").rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()
    assert graph._dealt(spark.range(500).select("id"), "id").rdd.getNumPartitions() == 50


def test_postings_of_a_block_are_whole_across_batches(spark, tmp_path, monkeypatch):
    """Blocks that lie over Arrow batches and slices give the rows that words listed one by one give, from two columns; only texts are shuffled."""
    monkeypatch.setattr(textindex, "BLOCK", 7)
    monkeypatch.setattr(textindex, "DOCS_AT_ONCE", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        texts = [(k, " ".join(f"w{(k * j) % 11}" for j in range(k % 9)), f"w{k % 3} w1" if k % 4 else None) for k in range(200)]
        index = textindex.TextIndex.build(spark.createDataFrame(texts, "id long, a string, b string"), "id", ("a", "b"), str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, *cells in texts:
        words = [(w, (c << 32) + at) for c, cell in enumerate(cells) for at, w in enumerate((cell or "").split())]
        for w, spot in words:
            want.setdefault((w, k, len(words)), []).append(spot)
    rows = index._read("postings", textindex.POSTINGS, index.segments).collect()
    assert {(r.term, d.id, d.length): d.spots for r in rows for d in r.docs} == want
    assert len({(r.term, r.block) for r in rows}) == len(rows) and all((r.n, r.max_tf, r.min_len) == (len(r.docs), max(len(d.spots) for d in r.docs), min(d.length for d in r.docs)) for r in rows)


def test_blocks_of_long_documents_hold_fewer():
    assert [textindex._block_size(4 * k) for k in (0, 14, 15, 20, 40)] == [128, 128, 64, 2, 1]


def test_a_published_table_is_derived_once(spark, tmp_path):
    """Rows of a table are made once for a publish, first and later; before, the sums made them once more. What is staged goes."""
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return k

    made = F.udf(counted, "long")
    table = lambda last: spark.range(40).select(made("id").alias("id"), F.when(F.col("id") == 0, last).otherwise("p").alias("name"), F.concat(F.lit("f"), "id").alias("file_path"))
    root = str(tmp_path / "v")
    for last in ("a", "b"):
        versions.publish(Index(spark, {"solutions": table(last)}), root)
        ix = versions.read_current(spark, root)
        assert ix.solutions.filter(f"name = '{last}'").count() == 1 and ix.solutions.count() == 40
    scratch, fs = versions._path(spark, versions._root(spark))
    assert not fs.exists(scratch) or not [s for s in fs.listStatus(scratch) if s.getPath().getName().startswith("publish-")]
    # one pass to write, and one that samples the ranges of the first version
    assert seen.value <= 40 * 3
