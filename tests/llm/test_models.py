"""Scores, classes and languages: held-out accuracy, sums that must hold, and defined cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import hpyp, language, quality

WORDS = {"en": "the of and that with from this have words there".split(), "fr": "le de et que avec pour dans être mots où".split()}


def prose(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_hpyp_scores(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, "en" if k % 2 else "fr"), "clash", 0.5) for k in range(120)] + [(500, None, "c", None), (501, "", "c", None), (None, "The OF unseen", "c", None), (3, prose(rng, "en"), "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, score double")
    got = hpyp.score(df.repartition(3)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t, *_ in rows:
        ws = tokens(t)
        want.setdefault(i, []).append((held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 for w in want[r.doc_id])
        assert r.score < 0
    out = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {(r.doc_id, r.n_tokens): r.score for r in hpyp.score(df.repartition(3)).collect()}
    assert all(abs(again[r.doc_id, r.n_tokens] - r.score) < 2.0 for r in got if r.doc_id != 3)
    assert hpyp.score(df.filter(F.lit(False))).count() == 0
    assert hpyp.perplexity(hpyp.score(df)).count() == 2


def test_hpyp_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 9, (5, 3))  # words by contexts
    t = np.where(c > 0, np.minimum(c, 2), 0)
    root = (t.sum(1) > 0).astype(int)
    m = hpyp.Model(int(c.sum()), 5, np.append(c.sum(0), 0), np.append(t.sum(0), 0), 0.6, 1.0, int(t.sum()), int(root.sum()), 0.4, 1.0)
    m.types = int((c.sum(1) > 0).sum())
    seen = c.sum(1) > 0
    parent = np.append(m.parent(t.sum(1), root)[seen], m.parent(np.zeros(1), np.zeros(1)))
    assert abs(parent.sum() - 1) < 1e-9
    for k in range(4):
        cc, tt = (np.append(x[seen, k], 0) if k < 3 else np.zeros(seen.sum() + 1) for x in (c, t))
        assert abs(m.after(np.array([k]), cc, tt, parent).sum() - 1) < 1e-9


def test_hpyp_contexts_of_equal_top_bits_stay_apart(spark):
    """Two words whose hashes agree in their top 16 bits are contexts of their own."""
    import xxhash

    seen = {}
    for k in range(10_000):
        top = xxhash.xxh64_intdigest(b"w%d" % k) >> 48
        if top in seen:
            one, two = f"w{seen[top]}", f"w{k}"
            break
        seen[top] = k
    docs = [(k, f"{one} left {two} right " * 20) for k in range(20)]
    asked = {10_007 + k: t for k, t in enumerate((f"{one} left", f"{one} right"))}
    assert all(not hpyp.held_out(k, 1 << 20) for k in asked)
    got = {r.doc_id: r.score for r in hpyp.score(spark.createDataFrame(docs + list(asked.items()), "doc_id long, text string").repartition(3), folds=1 << 20).collect()}
    # "right" came after the second word 400 times and once after the first
    assert got[10_007] - got[10_008] > 1


def test_table_counts_follow_their_distribution():
    """Draws of the number of tables against the exact conditional, by enumeration of seatings."""
    d, theta, p, others, c = 0.5, 1.0, 0.2, 3, 5
    ways = {}

    def seat(sizes, left, w):
        if not left:
            ways[len(sizes)] = ways.get(len(sizes), 0) + w
            return
        for k, s in enumerate(sizes):
            seat([*sizes[:k], s + 1, *sizes[k + 1 :]], left - 1, w * (s - d))
        seat([*sizes, 1], left - 1, w * (theta + d * (others + len(sizes))) * p)

    seat([], c, 1.0)
    n = 40_000
    got = np.bincount(hpyp.sample_tables(np.full(n, c), np.full(n, p), np.full(n, others), d, theta, hpyp.stirling(d), np.random.default_rng(1)), minlength=c + 1) / n
    want = np.array([ways.get(k, 0) for k in range(c + 1)]) / sum(ways.values())
    assert abs(got - want).max() < 0.01
    big = hpyp.sample_tables(np.array([10_000]), np.array([0.1]), np.array([5]), d, theta, hpyp.stirling(d), np.random.default_rng(1))
    assert 1 <= big[0] <= 10_000


def plain_quality(net, text):
    """The network's probability for one text, window by window."""
    b = (text or "").encode()
    chunks = max(1, math.ceil((len(b) - 512) / 448) + 1)
    b = b.ljust(chunks * 448 + 64, b"\0")
    taps, acts = net.conv.astype(np.float64).reshape(8, 6, 24), []
    for c in range(chunks):
        part = b[c * 448 : c * 448 + 512]
        seen = [sum(net.embed[part[at + k]].astype(np.float64) @ taps[k] for k in range(8)) for at in range(0, 505, 4)]
        acts.append([max(0.0, max(r[f] for r in seen) + net.bias[f]) for f in range(24)])
    z = sum(net.out[f] * sum(a[f] for a in acts) / chunks + net.out[24 + f] * max(a[f] for a in acts) for f in range(24))
    return 1 / (1 + math.exp(-(z + net.offset)))


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        text = prose(rng, "en", 80) + "." if good else rng.choice(["THE!! OF!! ", "x*** y### ", "spam spam "]) * 40
        rows.append((k, text, 0.1, None))
        labels.append((k, int(good), 0))
    rows += [(900, None, None, None), (901, "", None, None), (None, "no id", None, None), (1, rows[1][1], None, None), (902, prose(rng, "en", 30_000), None, None)]
    labels += [(1, 1, 0), (7777, 1, 0), (None, 1, 0), (8, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = quality.fit(docs, marks, epochs=8)
    got = quality.probabilities(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kind = {k: g for k, g, _ in labels if g is not None}
    held = [r for r in got if r.id is not None and r.id < 240 and zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == kind[r.id] for r in held) >= 0.95 * len(held)
    texts = {r[0]: r[1] for r in rows}
    few = [r for r in got if r.id is not None and (r.id < 60 or r.id in (900, 901))]
    assert max(abs(r.score - plain_quality(net, texts[r.id])) for r in few) < 1e-4
    kept = quality.keep(docs, net)
    assert kept.columns == docs.columns
    ok = {r.id for r in got if r.score >= 0.3}
    assert {r.doc_id for r in kept.collect()} == ok
    assert quality.probabilities(docs.filter(F.lit(False)), net).count() == 0
    assert {r.score for r in quality.probabilities(docs, quality.fit(docs, marks.filter(F.lit(False)))).collect()} == {0.5}
    # chunks of a very long text in pieces give what they give at once
    long = [prose(rng, "en", 700_000).encode()]
    flat, starts, owner = quality.layout(long)
    h = np.maximum(quality.pooled(quality.responses(net, flat), starts) + net.bias, 0)
    z = quality.combine(net, h, owner, 1)[1]
    assert abs(quality.score(net, long)[0] - 1 / (1 + np.exp(-z[0]))) < 1e-5


def test_language_evidence(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, prose(rng, lang), lang) for k in range(80) for lang in [("en", "fr")[k % 2]]] + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")
    pages = []
    for k in range(80):
        lang = ("en", "fr")[k % 2]
        host = f"http://{lang}{k % 4}.site.{'fr' if lang == 'fr' else 'org'}/p{k}"
        pages.append((k, host, f'<html lang="{lang}"><body><script>var the = 1;</script><p>{prose(rng, lang)}</p></body></html>', "clash"))
    pages += [(900, "http://fr1.site.fr/short", '<html lang="fr"><p></p></html>', None), (901, None, None, None), (902, "not a url", "", None), (None, pages[0][1], pages[0][2], None), (3, pages[3][1], pages[3][2], None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = language.identify(df, language.fit(docs)).collect()
    assert len(got) == len(pages) and all(0.5 - 1e-9 <= r.probability <= 1 for r in got)
    by = {r.page_id: r for r in got}
    assert all(by[k].language == ("en", "fr")[k % 2] for k in range(80))
    assert by[900].language == "fr" and by[900].host == "fr1.site.fr" and by[901].host == ""
    assert language.identify(df.filter(F.lit(False)), language.fit(docs)).count() == 0
    assert language.identify(df, language.fit(docs.filter(F.lit(False)))).count() == 0
    assert language.host_of("https://u@Blog.Example.CO:8/x") == ("blog.example.co", "example.co", "co")


def test_many_languages_and_long_texts(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(f"{k % 60}w{rng.randrange(50)}" for _ in range(40)), f"l{k % 60:02d}") for k in range(240)]
    docs = spark.createDataFrame([*texts, (999, " ".join(f"q{rng.randrange(90)}z" for _ in range(20_000)), "long")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 61
    pages = spark.createDataFrame([(1, "http://a.b/x", "<p>7w1 7w2 7w3 7w4 7w5</p>"), (2, None, "q1z q2z q3z q4z q5z"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.language for r in language.identify(pages, model).collect()}
    assert got[1] == "l07" and got[2] == "long" and len(got) == 3
    with pytest.raises(ValueError):
        language.fit(docs, most_languages=60)


def test_language_posteriors_equal_a_plain_sum(spark):
    """The fused probabilities against a plain computation from the same likelihoods."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, prose(rng, ("en", "fr")[k % 2]), ("en", "fr")[k % 2]) for k in range(60)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    rows = [(k, f"http://h{k % 3}.s{k % 2}.{('fr', 'org')[k % 2]}/", f'<html lang="{("en", "fr", "xx")[k % 3]}">{prose(rng, ("en", "fr")[k % 2])[:9]}</html>') for k in range(12)]
    got = {r.page_id: (r.language, r.probability) for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    n, q, lls, keys = len(model.languages), [], [], []
    for _, url, html in rows:
        total = sum((model.logp[g].sum(0, dtype=np.float64) for g in language.grams(language.plain(html))), np.zeros(n))
        ll = np.maximum((total - total.max()) * language.WEIGHT, -language.BOUND)
        lls.append(ll)
        q.append(np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum())
        host, domain, suffix = language.host_of(url)
        keys.append({"h": host, "d": domain, "s": suffix, "m": language.declared_language(html)})
    total, pages_n = sum(q), float(len(rows))
    share = (total + 1 / n) / (pages_n + 1)
    for k in range(len(rows)):
        held = {m: sum(q[j] for j in range(len(rows)) if keys[j][m] == keys[k][m]) for m in "hdsm"}
        less = {m: np.maximum(x - q[k], 0) for m, x in held.items()}
        domain = (less["d"] + 4 * share) / (less["d"].sum() + 4)
        prior = (less["h"] + 2 * domain) / (less["h"].sum() + 2)
        post = lls[k] + np.log(prior) + sum(np.log((less[m] + 4 * held[m].sum() / pages_n) / (total + 4)) for m in "sm")
        post = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        assert got[k][0] == model.languages[int(post.argmax())] and abs(got[k][1] - post.max()) < 1e-9
