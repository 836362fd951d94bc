from pyspark.sql import functions as F

from trellis.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate double, n long"


def docs(spark):
    big = [(k, "w " * (1 + k % 7), "big", 0.5, k) for k in range(900)]
    rows = big + [(1000 + k, "a b c", s, None, None) for k in range(60) for s in ("é", "z", None)] + [(5000, None, "empty", None, None), (5001, "", "empty", None, None), (None, "x y", "z", None, None), (1, "w w", "big", 0.5, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    """The rule as it is put: share, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_copies(spark):
    df = docs(spark)
    plan = mixing.plan(df).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = plain_targets(sizes)
    assert len(plan) == df.count()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.copies <= 3 and r.copies in (int(r.target / max(1, r.source_size)), int(r.target / max(1, r.source_size)) + 1)
    taken = sum(r.copies * r.size for r in plan if r.source == "big")
    assert abs(taken - want["big"]) < 0.2 * want["big"]
    again = {(r.id, r.draw): r.copies for r in mixing.plan(df.repartition(7)).collect()}
    assert again == {(r.id, r.draw): r.copies for r in plan}


def test_mix_emits_the_copies(spark):
    df = docs(spark)
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    want = {}
    for r in mixing.plan(df).collect():
        if r.copies:
            want[r.id, r.source] = want.get((r.id, r.source), 0) + r.copies
    assert got == want
    assert mixing.mix(df.filter(F.lit(False))).count() == 0 and mixing.plan(df.filter(F.lit(False))).count() == 0


def test_any_column_names(spark):
    """Names that the operators use inside don't clash with columns of the table."""
    from trellis.llm import lines

    names = ["row", "source_of", "copies", "copy", "rate", "of", "draw", "__mix_rate", "lost", "__lost", "lines", "new", "l_id", "h", "id", "text_hash"]
    docs = spark.createDataFrame([(k, "a b c d e\nsame line of words here\n" + str(k), f"s{k % 2}", *[f"v{k}"] * len(names)) for k in range(6)], ", ".join(["doc_id long", "text string", "source string", *[f"{n} string" for n in names]]))
    mixed, cut = mixing.mix(docs), lines.dedup(docs)
    assert mixed.columns == docs.columns == cut.columns
    assert all(r.row == f"v{r.doc_id}" == r["__mix_rate"] for r in mixed.collect())
    assert sorted((r.doc_id, r.lost, r.text) for r in cut.collect()) == [(k, f"v{k}", "a b c d e\nsame line of words here\n0" if not k else str(k)) for k in range(6)]
    assert mixing.mix(docs.limit(0)).count() == 0 == lines.dedup(docs.limit(0)).count()
