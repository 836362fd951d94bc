"""Line dedup and vector near-dedup against all pairs."""

import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from trellis.llm import lines, vectors

from .helpers import components


def test_lines_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(60)]
    base = [rng.sample(vocab, rng.choice([1, 3, 4, 5, 12, 40])) for _ in range(12)]
    long = [f"L{k}" for k in range(260)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rng.shuffle(words)
        return " ".join(words) + rng.choice(["", " ", "\t", "  " + words[0]])

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 6))), None, 0) for k in range(60)]
    rows += [(70, " ".join(long), None, 0), (71, " ".join(long[:-20] + [f"M{k}" for k in range(20)]), None, 0), (72, " ".join(long[:150]), None, 0), (80, None, "x", 1), (81, "", "x", 1), (82, "\n\n", "x", 1), (None, "w1 w2 w3 w4 w5\nonly here", "x", 1), (5, rows[5][1], None, 0), (6, "another text of six", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, pos int").repartition(3)
    import xxhash

    order = lambda i, t, k: (i is None, i or 0, np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64).item(), k)
    every = [(order(i, t, k), set(x.split())) for i, t, *_ in {r[:2] + r[2:] for r in rows} if t is not None for k, x in enumerate(t.split("\n"))]
    every = [(o, s) for o, s in every if s]

    def lost(o, s):
        return any(p < o and len(s & q) * 5 >= 4 * len(s | q) for p, q in every)

    want = []
    for i, t, a, b in rows:
        kept = None if t is None else [x for k, x in enumerate(t.split("\n")) if not x.split() or not lost(order(i, t, k), set(x.split()))]
        want.append((i, None if t is None else "\n".join(kept), a, b, 0 if t is None else len(t.split("\n")) - len(kept)))
    got = lines.dedup(df, count_col="gone")
    assert got.columns == [*df.columns, "gone"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert lines.dedup(df.filter(F.lit(False))).count() == 0
    assert lines.THRESHOLD == Fraction(4, 5)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([centre + rng.normal(scale=0.09, size=centre.shape) for _ in range(8)] + [rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(k, v.tolist(), 1, None) for k, v in enumerate(x)]
    rows += [(1000 + k, x[5].tolist(), 1, None) for k in range(9)]
    odd = [(2000, None, 1, 1), (2001, [], 1, 1), (2002, [0.0] * 16, 1, 1), (2003, [float("nan")] * 16, 1, 1), (2004, [float("inf")] + [1.0] * 15, 1, 1), (2005, [None] + [1.0] * 15, 1, 1), (2006, [1.0, 2.0], 1, 1), (2007, [2.0, 4.0], 1, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int, leaf int")
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    a, b = np.nonzero(np.triu(near, 1))
    comp = components(len(ids), zip(a.tolist(), b.tolist(), strict=True))
    want = {i: (int(near[k].sum()) - 1, ids[comp[k]]) for k, i in enumerate(ids)}
    want |= {r[0]: (0, r[0]) for r in odd} | {2006: (1, 2006), 2007: (1, 2006)}
    for tile in (4096, 16):  # small tiles take many units
        got = {r.id: (r.n_links, r.component) for r in vectors.near_duplicates(df, tile=tile).collect()}
        assert got == want
    assert vectors.near_duplicates(df.filter(F.lit(False))).count() == 0


def test_lines_are_cut_and_hashed_once(spark, monkeypatch):
    """Sets are made once a line, texts hashed once a text, and lines that stay not cut from the text one by one."""
    plans = {}

    class Seen(lines.Scratch):
        def __init__(self, df, label, **more):
            plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
            super().__init__(df, label, **more)

    monkeypatch.setattr(lines, "Scratch", Seen)
    out = lines.dedup(spark.createDataFrame([(1, "a b\nc d\na b"), (2, "a b\n\ne f")], "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, "a b\nc d"), (2, "\ne f")]
    sets = plans["lines-sets"]
    assert sets.count("array_distinct(") == 1
    assert sets.index("Generate") < sets.index("xxhash64(text")
    assert "lambdafunction(element_at(lines" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_reread_only_texts_with_places(spark, monkeypatch):
    """The filter of the texts that are read again loses none, null ids included, leaves out most others, and changes no result."""
    monkeypatch.setattr(lines, "FILTER", 1 << 20)
    keys = ["id", "text_hash"]
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("text_hash")).unionByName(spark.createDataFrame([(None, 5)], "id long, text_hash long"))
    wanted = rows.filter("id % 7 = 0 or id is null")
    met = lines._only(rows, keys, wanted, keys)
    assert met.exceptAll(rows).isEmpty() and wanted.exceptAll(met).isEmpty()
    assert met.count() < 1.05 * wanted.count()
    texts = [(i, "\n".join(f"w{i * j % 50} a{i % 9} b{j} c d e f g h" for j in range(6))) for i in range(60)] + [(None, "x y z w v u t s\nx y z w v u t s")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few, many = lines.removed(docs), lines.removed(docs, broadcast_bytes=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) != []
