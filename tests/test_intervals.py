"""Interval joins, source lines and comments against plain models."""

import random
import time

from pyspark.sql import functions as F

from trellis.operators import source_context
from trellis.operators.intervals import counts_inside, innermost, nodes
from trellis.sources import extract_comments


def test_nodes_tile_an_interval(spark):
    rng = random.Random(1)
    ends = [(0, 0), (1, 1), (-5, 9), (0, 2**31 - 1), (-(2**31), 2**31 - 1)] + [tuple(sorted(rng.choices(range(-300, 300), k=2))) for _ in range(200)]
    for r in spark.createDataFrame(ends, "a long, b long").select("a", "b", nodes("a", "b").alias("n")).collect():
        spans = sorted((n.at << n.level, ((n.at + 1) << n.level) - 1) for n in r.n)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:])) and len(spans) <= 64


def test_interval_joins_equal_all_pairs(spark):
    rng = random.Random(2)
    intervals = [(k, rng.choice("fg"), a, a + rng.choice([-1, 0, 1, 5, 60])) for k, a in enumerate(rng.choices(range(-20, 80), k=150))] + [(500, "f", None, 4), (501, "f", 3, None), (502, "h", 1, 2)]
    points = [(rng.choice("fgx"), rng.randrange(-30, 150), "c") for _ in range(200)] + [("f", None, "c"), (None, 3, "c")]
    iv = spark.createDataFrame(intervals, "id long, file string, line_start int, line_end int")
    pts = spark.createDataFrame(points, "file string, line int, text string")
    holds = lambda i, p: i[1] == p[0] and None not in (i[2], i[3], p[1]) and i[2] <= p[1] <= i[3]
    best = {}
    for p in points:
        found = [(-i[2], i[0]) for i in intervals if holds(i, p)]
        if found:
            best[p[0], p[1]] = min(found)[1]
    assert {(r.file, r.line): r.id for r in innermost(pts, iv, ["file"]).collect()} == best
    want = {i[0]: sum(holds(i, p) for p in points) for i in intervals}
    assert {r.id: r["count"] for r in counts_inside(iv, pts, ["file"]).collect()} == {k: n for k, n in want.items() if n}
    assert innermost(pts.limit(0), iv, ["file"]).count() == 0 and counts_inside(iv.limit(0), pts, ["file"]).count() == 0


def test_nested_symbols_of_one_file_make_no_pairs(spark):
    """100,000 symbols, each in the one before, and as many comments in the innermost: 10^10 pairs, which nobody could wait for."""
    n = 100_000
    iv = spark.range(n).select("id", F.lit("f").alias("file"), F.col("id").cast("int").alias("line_start"), (3 * n - F.col("id")).cast("int").alias("line_end"))
    pts = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") + n).cast("int").alias("line"))
    begun = time.time()
    assert innermost(pts, iv, ["file"]).agg(F.count("*"), F.min("id"), F.max("id")).first()[:] == (n, n - 1, n - 1)
    assert counts_inside(iv, pts, ["file"]).agg(F.sum("count")).first()[0] == n * n
    assert time.time() - begun < 120


def test_lines_as_a_reader_of_all_lines_gives_them(spark):
    texts = {"a\nb\n": ["a", "b"], "a\rb\rc": ["a", "b", "c"], "": [], "\n": [""], "a\r\n\r\nb": ["a", "", "b"], "x": ["x"], "a\n\n": ["a", ""]}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").withColumn("k", F.col("text"))
    got = {}
    for r in source_context(df, "text", 3, 5).orderBy("k", "line").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {k: v for k, v in texts.items() if v}


def test_comments_are_not_in_strings(spark):
    cases = {
        '$"{f("x // TODO no")}" // TODO a': [(1, "TODO", "a")],
        '"""say " // TODO no """ // HACK b': [(1, "HACK", "b")],
        '""""\n""" // TODO no\n"""" // FIXME c': [(3, "FIXME", "c")],
        '$$"""{{x}} // TODO no""" /* NOTE d */': [(1, "NOTE", "d")],
        'f(@"c:\\" + "//TODO no"); // TODO e': [(1, "TODO", "e")],
        '$@"{g("// TODO no")} "" // TODO no" // TODO f': [(1, "TODO", "f")],
        '$"{{ {a[\'"\']} // TODO no" // TODO g': [(1, "TODO", "g")],
        "'\"' // TODO h\n/* \n\n TODO open": [(1, "TODO", "h"), (2, "TODO", "open")],
        '"open // TODO i\n// TODO j': [(1, "TODO", "i"), (2, "TODO", "j")],
    }
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(cases)] + [("n", None)], "file_path string, text string")
    got = {}
    for r in extract_comments(files).orderBy("file_path", "line").collect():
        got.setdefault(r.file_path, []).append((r.line, r.tag, r.text))
    assert got == {str(k): v for k, v in enumerate(cases.values())}


def test_comments_of_long_texts_take_linear_time(spark):
    begun = time.time()
    rows = [("a", "/* " * 300_000), ("b", "// TODO x\n" * 40_000), ("c", '@"' * 200_001), ("d", '"' * 99_999)]
    assert extract_comments(spark.createDataFrame(rows, "file_path string, text string")).groupBy("file_path").count().collect()[0][:] == ("b", 40_000)
    assert time.time() - begun < 60
