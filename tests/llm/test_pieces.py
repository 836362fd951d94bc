import os
import tracemalloc
from itertools import count

import pytest
from pyspark.sql import functions as F

from trellis.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")

TEXTS = ["Hello  world\n a\tb ¿é", "", None, " x ", "the the\n\n\nthe", "日本語テキスト émenté", "🙂 ok", "a" * 3000, "word\r\nnext  ", "x=1;\n\tif (y) { return; }", "lead and trail "]
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def docs(spark):
    return spark.createDataFrame([(k, t, "clash", None) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", None), (None, "no id", None, None)], SCHEMA)


def path(text, p, cut):
    return [i for u in cut(text) for i in pieces.best_path(u, p)]


def test_equals_the_best_path_and_decodes(spark):
    p = pieces.load()
    cut = pieces.cutter(p)
    got = pieces.encode(docs(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(TEXTS):
        r = by[k]
        if t is None:
            assert r.ids is None and r.n_tokens is None and r.intact is None
        else:
            assert r.intact and r.n_tokens == len(r.ids) and r.ids == path(t, p, cut), t
    back = pieces.decode(pieces.encode(docs(spark)).select("doc_id", "ids")).collect()
    assert {(r.doc_id, r.text) for r in back} == {*((k, t) for k, t in enumerate(TEXTS)), (None, "no id")}
    assert pieces.encode(docs(spark).filter(F.lit(False))).count() == 0


def all_paths(unit, p):
    """Every way to spell a unit: (score, ids)."""
    if not unit:
        return [(0.0, [])]
    out = []
    for e in range(1, len(unit) + 1):
        got = p.texts.get(unit[:e])
        if got or e == 1:
            ids, x = ([got[0]], got[1]) if got else ([p.bytes_at[b] for b in unit[0].encode()], p.fallback)
            out += [(x + y, ids + rest) for y, rest in all_paths(unit[e:], p)]
    return out


def test_the_fold_finds_the_best_of_all_paths(spark):
    p = pieces.load()
    cut = pieces.cutter(p)
    units = sorted({u for t in TEXTS if t and len(t) < 100 for u in cut(t)} | {"▁understanding", "▁émenté", "ha" * 7, "a" * 400, "-" * 500})
    got = {r.unit: r.ids for r in pieces.viterbi_units(spark.createDataFrame([(u,) for u in units], "unit string"), p).collect()}
    assert got == {u: pieces.best_path(u, p) for u in units}
    for u in units:
        if len(u) < 15:
            paths = all_paths(u, p)
            best = max(x for x, _ in paths)
            assert got[u] in [ids for x, ids in paths if abs(x - best) < 1e-3], u


LONG = ["a" * 3000, "-" * 200, "=" * 130, " " * 700 + "x", "a" * 128, "ha" * 40_000, "-" * 300_000]


def test_long_units_are_encoded_whole(spark):
    """Units above UNIT characters have the ids of their whole best path."""
    p = pieces.load()
    cut = pieces.cutter(p)
    assert all("".join(cut(t)) == pieces.SPACE + t.replace(" ", pieces.SPACE) for t in LONG)
    assert max(len(u) for t in LONG for u in cut(t)) > pieces.UNIT
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")).collect()}
    for k, t in enumerate(LONG):
        assert got[k].ids == path(t, p, cut) and got[k].intact, t[:50]


def test_merges_equal_the_library(spark):
    import random

    import sentencepiece

    rng = random.Random(5)
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice(["the", "ing", "ab", "é", "日", "and"]) for _ in range(900)), *LONG]
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), merges=True).collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == m.encode(t) and got[k].intact, t[:50]


def test_repeats_and_small_chunks(spark, monkeypatch):
    """Texts dealt over many chunks and many tasks of units give the same ids."""
    monkeypatch.setattr(pieces, "CHUNK_WORDS", 3)
    monkeypatch.setattr(pieces, "TASK_UNITS", 5)
    monkeypatch.setattr(pieces, "PACK_UNITS", 7)
    p = pieces.load()
    cut = pieces.cutter(p)
    texts = [f"the {k % 3} same words {k % 2} again" for k in range(40)]
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids for r in got} == {k: path(t, p, cut) for k, t in enumerate(texts)} and len(got) == 40


def chunk_of(cut, texts):
    words, first, size = {}, [], 0
    for t in texts:
        found = cut.words(t)
        first.append(pieces.np.fromiter(map(words.setdefault, found, count(size)), pieces.np.uint32, len(found)))
        size += len(found)
    return words, first


def test_chunk_is_whole_in_small_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 2)
    monkeypatch.setattr(pieces, "BLOCK", 3)
    cut = pieces.cutter(pieces.load())
    for texts in ([t or "" for t in TEXTS], ["", "", "a b c", "", "a b", ""], ["", ""], ["the of and", "the"]):
        c = pieces.Chunk(cut, *chunk_of(cut, texts))
        ends = pieces.np.cumsum(c.lengths).tolist()
        assert [[c.units[k] for k in c.flat[e - n : e]] for e, n in zip(ends, c.lengths.tolist(), strict=True)] == [cut(t) for t in texts]


def test_chunk_takes_little_memory(monkeypatch):
    """Making a chunk holds little beside its places; it took several arrays of eight bytes a word, and all words' units as texts."""
    cut = pieces.cutter(pieces.load())
    monkeypatch.setattr(pieces, "BLOCK", 20_000)
    words, first = chunk_of(cut, ["the same few words of one text again and again "] * 60_000)
    n = sum(map(len, first))
    tracemalloc.start()
    try:
        pieces.Chunk(cut, words, first)
        few = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert few < 20 * n, few / n
