import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.llm import phrases

SCHEMA = "lang string, text string, chunk string, id long"


def plain(rows, longest=5, least=100, share=100, top=2000):
    """The rule as it is put, over all phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        if any(100 * b >= share * a for (o, q), b in cand.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r, n[lang]))
    rank, got = Counter(), []
    for lang, score, a, p, l, r, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, l, r, total, -score))
    return got


def texts(seed, rows):
    rng = random.Random(seed)
    words = ["a", "A", "b", "é", "É", "c-d", " x", "\x1cy", "the", "of"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]
    make = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "de", None, "und"]), rng.choice([make(), make(), "a b c d e f g", None, "", "the the the the"])) for _ in range(rows)]


@pytest.mark.parametrize("chunk_words, share", [(3, 100), (50, 60), (100_000, 100)])
def test_phrases_equal_the_rule(spark, chunk_words, share):
    rows = texts(5, 260)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    want = plain(rows, least=9, share=share, top=12)
    got = [tuple(r) for r in phrases.collocations(df, least=9, share=share, top=12, chunk_words=chunk_words).orderBy("lang", "rank").collect()]
    assert got == want and {r[0] for r in got} == {"en", "de", "und"} and max(len(r[2].split(" ")) for r in got) == 5


def test_empty_and_hot(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b", "x", 1), (None, None, "x", 1), ("en", " . ", None, None)], SCHEMA)).collect() == []
    rows = [("en", "same passage over and over")] * 400 + [("de", "x " * 5000)]
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA), chunk_words=77).orderBy("lang", "rank").collect()]
    assert got == plain(rows)


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_007, 30_000_000_000_000_001, [9_000_000_000_011, 9_000_000_000_007], [9_000_000_000_013, 9_000_000_000_007])], "a long, n long, firsts array<long>, lasts array<long>")
    score = df.select(phrases._cuts(2).alias("c")).first().c.score
    assert score == 1000 * 9_000_000_000_007 * 30_000_000_000_000_001 // (9_000_000_000_011 * 9_000_000_000_013)


def test_a_text_is_cut_without_loss(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 7)
    for text in ("one two.three  four\tfive" * 9, "x" * 100, "", ". .", "longword " * 5):
        raw = text.encode().translate(phrases.TABLE)
        assert sum(phrases.tokens(raw), []) == raw.replace(b".", b" . ").split() + [b"."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 40))
def test_a_merge_finds_all_longer_phrases(words, own):
    flat = np.array(words, np.int64)
    at = np.flatnonzero(flat)
    ids = np.array([10, 11, -1])
    where, keys, buckets, lefts, rests, counts = phrases.extend(at, flat[at] - 1, ids, np.array([1, 3, 1]), own, 4)
    live = [w if w < 3 else 0 for w in words]
    want = [(i, (live[i] + 9, live[i + 1] + 9)) for i in range(len(live) - 1) if live[i] and live[i + 1]]
    assert [(int(p), (int(lefts[k]), int(rests[k]))) for p, k in zip(where, keys)] == want
    assert {(int(a), int(b)): int(c) for a, b, c in zip(lefts, rests, counts)} == {k: sum(i < own for i, q in want if q == k) for _, k in want}
    assert list(buckets) == sorted(buckets)


def test_buckets_and_salts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SALT", 5)
    monkeypatch.setattr(phrases, "BUCKET", 30)
    monkeypatch.setattr(phrases, "MERGED", 20)
    rows = texts(6, 200)
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA), least=9, chunk_words=60).orderBy("lang", "rank").collect()]
    assert got == plain(rows, least=9)
