import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trellis.llm import simhash

from .helpers import components, near_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component long"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprint_equals_a_plain_sum():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(["The", "été", "a b", "x\ty", "word"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_equal_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(12)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for block in (4096, 8):  # small blocks take the path of large groups
        got = simhash.connected_components(simhash.links(df, 4, block)).collect()
        at = {int(np.int64(f).astype(np.uint64)): i for f, i in [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]}
        sets = {}
        for r in got:
            sets.setdefault(r.component, set()).add(at[int(np.int64(r.node).astype(np.uint64))])
        want = {}
        for i, c in enumerate(components(len(fps), near_pairs(fps, 4))):
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_defined_cases(spark):
    long = "word salad of many things " * 3000
    rows = [(3, "a b c d e", None, None, 1, "x", 9), (1, "a b c d e", "en", "s", 1, "x", 9), (1, "a b c d e", "en", "s", 1, "x", 9), (None, "a b c d e", "en", "s", 1, "x", 9), (5, None, None, None, None, None, None), (4, "", "en", "s", 0, "x", 9), (7, long, "en", "s", 1, "x", 9), (8, "quite other words stand here now", "en", "s", 1, "x", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.component) for r in simhash.groups(docs).collect()}
    assert got == {(3, 1), (1, 1), (None, 1), (5, 4), (4, 4), (7, 7), (8, 8)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8]
    assert simhash.groups(docs.filter(F.lit(False))).count() == 0
    assert simhash.keep_first(docs.filter(F.lit(False))).count() == 0


def test_pipeline_stage_finds_edited_copies(spark):
    """Planted near copies against all pairs by exact Jaccard similarity; clean documents stay."""
    import pytest

    stage = pytest.importorskip("corpus_pipeline").simhash_stage
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(40, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "One  two", "a b c d e", "a b c d f", " ".join(word() for _ in range(100)) + " " + texts[0]]
    rng.shuffle(texts)

    def cut(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [cut(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "x", 9) for k, t in enumerate(texts)] + [(None, "no id here", "en", "s", 1, "x", 9)] * 2, SCHEMA)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=lambda i: (i is None, i)) == [*sorted(set(components(len(texts), pairs))), None]
    assert stage(spark, docs.filter(F.lit(False)), "").count() == 0


def test_keep_similar_at_the_edge_of_the_threshold(spark):
    """Pairs just above and below 0.8 at every length from 8 words on, a frequent passage, repeated rows; against all pairs."""
    rng = random.Random(8)
    fresh = iter(range(10**9))
    word = lambda: f"v{next(fresh)}"
    passage = [word() for _ in range(30)]
    texts, shared = [], 0
    for n in [*range(8, 60), 80, 120, 200]:
        base = [word() for _ in range(n)]
        own = n - 4
        # words put before it leave all shingles as they are: own of own + more are shared
        for more in {own // 4, own // 4 + 1}:
            texts += [" ".join(base), " ".join([word() for _ in range(more)] + base)]
            shared += 5 * own >= 4 * (own + more)
    texts += [" ".join([word() for _ in range(rng.randrange(40))] + passage + [word() for _ in range(rng.randrange(9))]) for _ in range(60)]

    def cut(t):
        ws = t.split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    sets = [cut(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > shared > 50
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_similar(docs).collect()) == sorted(set(components(len(texts), pairs)))


def test_steps_drop_what_is_no_result(spark):
    import os

    from trellis.llm.common import Scratch, steps

    with steps():
        with steps():
            a, b = Scratch(spark.range(3), "test"), Scratch(spark.range(4), "test", result=True)
        at = [x.path.removeprefix("file://") for x in (a, b)]
        assert [os.path.exists(p) for p in at] == [False, True] and b.read().count() == 4
    assert not os.path.exists(at[1])
