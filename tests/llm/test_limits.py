"""What long texts, odd numbers and many buckets must not break."""

import random
import re
import time

import numpy as np
import pytest

from trellis.llm import common, hpyp, language, pieces, vectors

DROP = re.compile(rb"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,10};")


def test_plain_drops_what_the_pattern_drops():
    rng = random.Random(1)
    bits = ["<script>", "</script>", "</SCRIPT  >", "<style a=b>", "</style>", "<!--", "-->", "<", ">", "<p>", "&amp;", "&#12;", "& ", "text", "é", "\n", "<scripty>", "<noscript", "</ script>"]
    for _ in range(3000):
        html = "".join(rng.choices(bits, k=rng.randrange(12)))
        assert language.plain(html) == DROP.sub(b" ", html.encode()), html
    assert language.plain(None) == b""


@pytest.mark.parametrize("mark", ["<script ", "<!-- ", "<", "<style><", "<noscript>x", "&amp", "<html ", "<html lang ", "</script", "<!-->"])
def test_marks_that_nothing_closes_take_linear_time(mark):
    begun = time.time()
    html = mark * ((1 << 20) // len(mark))
    language.plain(html)
    language.declared_language(html)
    assert time.time() - begun < 3


def test_declared_language():
    cases = {'<html lang="fr">': "fr", "<HTML dir=ltr xml:lang = 'de'>": "de", "<html><html lang=es>": "es", "<p lang=en>": None, '<html class="x">lang=en': None, "<html lang=english>": None}
    assert {h: language.declared_language(h) for h in cases} == cases


def test_vectors_of_doubles(spark):
    rows = [(0, [1e39, 0.0]), (1, [1e39, 1e30]), (2, [1e-50, 0.0]), (3, [1e300, 1e300]), (4, [2e-320, 2e-320]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [float("nan"), 1.0]), (8, None), (9, [1.0, None]), (10, [3.0, 3.0])]
    got = {r.id: (r.n_links, r.component) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (2, 3), 4: (2, 3), 10: (2, 3)} | {k: (0, k) for k in (5, 6, 7, 8, 9)}


def test_more_parts_than_buckets(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["one", "two", "three", "four", "five"], k=rng.randrange(60)))) for k in range(80)], "doc_id long, text string")
    scores = lambda: {r.doc_id: round(r.score, 4) for r in hpyp.score(docs).collect()}
    ids = lambda: sorted(map(str, pieces.encode(docs).collect()))
    monkeypatch.setattr(hpyp, "PART_BYTES", 1000)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 1000)
    want = scores(), ids()
    before = spark.conf.get(*common.MOST_BUCKETS)
    spark.conf.set(common.MOST_BUCKETS[0], "2")
    try:
        got = scores(), ids()
    finally:
        spark.conf.set(common.MOST_BUCKETS[0], before)
    assert got[1] == want[1] and got[0].keys() == want[0].keys() and all(np.isclose(got[0][k], want[0][k], atol=0.01) for k in got[0])


def test_hpyp_asks_in_halves(spark, monkeypatch):
    """Requests are written in two halves, each with its own shuffle; one task's documents are all in one of them."""
    made = []

    class Seen(common.Buckets):
        def __init__(self, df, key, buckets, label):
            super().__init__(df, key, buckets, label)
            made.append({r.chunk >> 32 for r in self.read().select("chunk").collect()})

    monkeypatch.setattr(hpyp, "Buckets", Seen)
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["one", "two", "three"], k=9))) for k in range(40)], "doc_id long, text string")
    for tasks, want in ((4, [{0, 2}, {1, 3}]), (1, [{0}, set()])):
        made.clear()
        assert sorted(r.doc_id for r in hpyp.score(docs.repartition(tasks)).collect()) == list(range(40))
        assert made == want
