"""Full-text expressions against SQLite, and the stored index against weighing all rows."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from trellis.catalog import Index
from trellis.operators import semantic_search
from trellis.operators.fulltext import parse, phrases_of
from trellis.operators.search import SEARCHED, bm25, match_terms
from trellis.sources.textindex import TextIndex

WORDS = ["load", "loader", "foo_bar", "été", "save", "x1", "the"]


def documents(rng, n, longest=16):
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5))) or None, " ".join(rng.choices(WORDS, k=rng.randrange(longest)))) for i in range(n)]


def sqlite(docs):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(a, b)")
    db.executemany("insert into t(rowid, a, b) values (?, ?, ?)", [(i + 1, a, b) for i, a, b in docs])
    return db


class Expressions:
    """Random expressions of all forms of the grammar."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def phrase(self):
        r = self.rng.random()
        if r < 0.65:
            return self.rng.choice(["load", "loader", "ete", "save", "x1", "the", "foo_bar", "lo*", '"x1 t"*', "foo*"])
        return " ".join(self.rng.choices(["load", "save", "the", "x1"], k=2)).join('""') if r < 0.9 else self.rng.choice(["load + save", 'the + "x1 save"'])

    def group(self):
        r = self.rng.random()
        if r < 0.75:
            return ("^" if r > 0.65 else "") + self.phrase()
        return f"NEAR({' '.join(self.phrase() for _ in range(self.rng.randrange(1, 4)))}{self.rng.choice(['', ', 0', ',1', ', 3'])})"

    def make(self, depth=2):
        r = self.rng.random()
        if depth == 0 or r < 0.3:
            return " ".join(self.rng.choice(["", "", "", "a: ", "b : ", "{a b}: ", "-a: ", "- {a b} : "]) + self.group() for _ in range(self.rng.choice([1, 1, 2])))
        if r < 0.44:
            return f"{self.rng.choice(['', '', 'a:', '-b: '])}({self.make(depth - 1)})"
        return f"{self.make(depth - 1)} {self.rng.choice(['AND', 'OR', 'NOT'])} {self.make(depth - 1)}"


def test_expressions_equal_sqlite(spark):
    """Rows are SQLite's always. So are scores, but where a NEAR group of several phrases stands beside other
    matches: SQLite then also counts phrases of a group that doesn't match."""
    docs, some = documents(random.Random(4), 120), Expressions(5)
    db = sqlite(docs)
    df = spark.createDataFrame(docs, "id long, a string, b string").coalesce(1).cache()
    exact = 0
    for _ in range(40):
        q = some.make()
        want = {r - 1: -s for r, s in db.execute("select rowid, rank from t where t match ?", (q,))}
        got = {r.id: r.score for r in bm25(df, "id", ("a", "b"), q).collect()}
        assert got.keys() == want.keys(), q
        if "NEAR" not in q or not any(x in q for x in (" OR ", " NOT ")):
            exact += 1
            assert all(abs(got[k] - want[k]) < 1e-9 for k in got), q
    assert exact > 15


def test_what_breaks_the_grammar_counts_as_words():
    words = lambda q: [w for p in phrases_of(parse(q, ("a",))) for w, _ in p.words]
    for q in ("global::A.B", "Foo(", 'a "b', "a AND", "nosuch : a b", "NEAR(a b, x)", "a (b)", "*a", "a - b"):
        assert words(q) == [w for w in q.lower().replace("global::", "global ").replace("a.b", "a b").translate({ord(c): " " for c in '(",:*-)'}).split()], q
    assert parse('"..." OR ""') is None and parse(None) is None and words('a AND "."') == ["a"]


def test_precedence():
    def shape(t):
        return "".join(w for w, _ in t.phrases[0].words) if t.phrases else f"{t.kind}({','.join(map(shape, t.children))})"

    assert shape(parse("a OR b AND c NOT d e")) == "or(a,and(b,not(c,and(d,e))))"
    assert shape(parse("(a OR b) AND c")) == "and(or(a,b),c)" and shape(parse("a NOT b NOT c")) == "not(not(a,b),c)"


QUERIES = ("load save", "x1", "the OR loader", "load NOT (save OR x1)", "(load save) OR loader", "ete AND (the OR x1)", '"load save"', "lo* OR ete", "a: load", "NEAR(load the, 1)", "zzz", "zzz OR x1", "")


def same(a, b):
    return [(r.id, round(r.score, 9)) for r in a.collect()] == [(r.id, round(r.score, 9)) for r in b.collect()]


def test_a_stored_index_equals_weighing_all_rows(spark, tmp_path):
    rng = random.Random(6)
    docs = documents(rng, 900) + [(5000, None, None), (5001, "", "the " * 400)]
    df = spark.createDataFrame(docs, "id long, a string, b string").cache()
    index = TextIndex.build(df, "id", ("a", "b"), str(tmp_path / "i"))
    for q in QUERIES:
        assert same(index.search(q, 7), match_terms(df, "id", ("a", "b"), q, 7)), q
    index.search("load save", 3).collect()
    assert index.read[0] < index.read[1]
    plan = index.search("load", 3)._jdf.queryExecution().toString()
    assert "EqualTo(term,load)" in plan and "In(block" in plan or "EqualTo(block" in plan


def test_an_index_follows_updates(spark, tmp_path):
    rng = random.Random(7)
    docs = documents(rng, 300)
    df = spark.createDataFrame(docs, "id long, a string, b string").cache()
    first = TextIndex.build(df, "id", ("a", "b"), str(tmp_path / "i"))
    for step in range(2):
        fresh = [(i, a, b) for i, a, b in documents(rng, 700) if i % 7 == step]
        gone = [(i,) for i in range(0, 300, 11)]
        TextIndex.open(spark, first.root).update(spark.createDataFrame(fresh, df.schema), "id", spark.createDataFrame(gone, "id long") if step else None)
        old = {i: (i, a, b) for i, a, b in docs} | {i: (i, a, b) for i, a, b in fresh}
        docs = [r for i, r in old.items() if not (step and i % 11 == 0 and i < 300 and i % 7 != step)]
        now = spark.createDataFrame(docs, df.schema)
        for q in ("load save", '"load save"', "the OR x1", "lo*"):
            assert same(TextIndex.open(spark, first.root).search(q, 9), match_terms(now, "id", ("a", "b"), q, 9)), (step, q)
    assert same(first.search("load", 5), match_terms(df, "id", ("a", "b"), "load", 5))


def test_symbols_are_found_in_a_stored_index(spark, tmp_path):
    rng = random.Random(8)
    symbols = [(i, 1, f"N.T{i}", rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.randrange(9))), rng.choice(["class", "method"])) for i in range(400)]
    ix = Index(spark, {"symbols": spark.createDataFrame(symbols, "id long, project_id long, fqn string, display_name string, doc_comment string, kind string")})
    text = TextIndex.build(ix.symbols, "id", SEARCHED, str(tmp_path / "i"))
    for q, options in (("load save", {}), ("load OR x1", {"kind": "Class"}), ('"load save"', {"max_results": 3}), ("display_name: lo*", {"kind": "method", "strict_topk": True}), ("the", {"max_results": 0})):
        want, got = ([(r.id, round(r.score, 9)) for r in semantic_search(ix, q, text=t, **options).orderBy(F.desc("score"), "id").collect()] for t in (None, text))
        assert got == want and (len(got) > 0) == (q != "the"), q


def test_empty_and_odd(spark, tmp_path):
    none = spark.createDataFrame([], "id long, a string")
    index = TextIndex.build(none, "id", ("a",), str(tmp_path / "i"))
    assert index.search("x", 5).collect() == []
    more = index.update(spark.createDataFrame([(1, "x"), (1, "x y"), (2, None)], "id long, a string"))
    assert [r.id for r in more.search("y", 5).collect()] == [1]
    with pytest.raises(Exception, match="a document has an id"):
        TextIndex.build(spark.createDataFrame([(None, "x")], "id long, a string"), "id", ("a",), str(tmp_path / "j"))
