"""Language identification by Bayesian evidence fusion (operator 10).

A page's text gives likelihoods from byte n-gram models. Its declared markup language and
the last label of its address's host are evidence with probabilities of their own, and its
host has a prior, smoothed by that of its registered domain, which is smoothed by that of
all pages. Those tables are grouped sums over all pages of what the texts say; a page's
own share is taken out of its host's and domain's, so that its text doesn't count twice.

Defined cases: a null or empty page has even likelihoods; a null address has an empty
host, a missing declaration an empty one, and each is a value like any other; with no
labelled text the languages are none and the table is empty. Of equally probable languages
the first in order of code points wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS = 1 << 17
PIECE = 1 << 20
#: How much of a sum over overlapping n-grams counts, and its bound in nats: neighbours repeat each other.
WEIGHT, BOUND = 0.25, 40.0

_MARK = re.compile(rb"(?i)<(script|style|noscript)\b|<!--|<|&[#\w]{1,10};")
_ENTITY = re.compile(rb"&[#\w]{1,10};")
_CLOSE = {n: re.compile(rb"(?i)</" + n + rb"\s*>") for n in (b"script", b"style", b"noscript")}
_HTML = re.compile(r"(?i)<html\b[^>]*")
_LANG = re.compile(r"(?i)\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


@dataclass
class Texts:
    """Byte n-gram models: log probabilities (BUCKETS, languages)."""

    languages: list[str]
    logp: np.ndarray


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams of the bytes, lower-cased, in pieces of bounded size."""
    a = np.frombuffer(b" " + data.lower() + b" ", np.uint8)
    for k in range(0, len(a), PIECE):
        x = a[k : k + PIECE + 3].astype(np.uint32)
        h = x
        for n in (2, 3, 4):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]
            yield ((h * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64)[:PIECE]


def declared_language(html: str) -> str | None:
    """The language that a page's markup declares, as it is written; a tag is read once."""
    return next((m[1] for tag in _HTML.finditer(html) if (m := _LANG.search(tag[0]))), None)


def plain(html: str | None) -> bytes:
    """Text of a page: tags, comments, scripts and entities are dropped, each for a space.

    The page is read once from the left. An end that is missing is looked for once only, so
    marks that nothing closes, which stay, cost no more than others.
    """
    data = (html or "").encode()
    parts, at, missing = [], 0, set()
    while m := _MARK.search(data, at):
        end, mark = None, m[0]
        if mark[:1] == b"&":
            end = m.end()
        if m[1] and (name := m[1].lower()) not in missing:
            c = _CLOSE[name].search(data, m.end())
            end = c.end() if c else missing.add(name)
        elif mark == b"<!--" and mark not in missing:
            k = data.find(b"-->", m.end())
            end = k + 3 if k >= 0 else missing.add(mark)
        if end is None:
            k = data.find(b">", m.start())
            if k < 0:  # nothing that begins with < ends any more
                break
            end = k + 1
        parts += (data[at : m.start()], b" ")
        at = end
    return b"".join(parts) + _ENTITY.sub(b" ", data[at:])


def train(texts: list[tuple[str, str]]) -> Texts:
    languages = sorted({lang for lang, _ in texts})
    counts = np.zeros((len(languages), BUCKETS))
    for lang, text in texts:
        for g in grams(text.encode()):
            counts[languages.index(lang)] += np.bincount(g, minlength=BUCKETS)
    smooth = counts + 0.05
    return Texts(languages, np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy() if languages else np.zeros((BUCKETS, 0), np.float32))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, longest: int = 32768, most_languages: int = 200) -> Texts:
    """Models from a sample of labelled texts: about per_language rows of each language by a hash, of up to longest bytes.

    The bounds are parameters; a longer text is drawn by its beginning. More than most_languages
    languages, for which the models would be too large, raise an error.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = {r.lang: min(1.0, per_language / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(share) > most_languages:
        raise ValueError(f"there are more than {most_languages} languages; raise most_languages")
    if not share:
        return train([])
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) / (1 << 30)
    short = F.when(F.octet_length("text") > longest, F.substring("text", 1, longest // 4)).otherwise(F.col("text")).alias("text")
    got = rows.select("id", "lang", short).filter(F.col("lang").isin(list(share)) & (draw < rate)).select("lang", "text").limit(2 * per_language * len(share)).collect()
    return train(sorted((r.lang, r.text) for r in got))


EVIDENCE = "page_id long, host string, domain string, suffix string, declared string, ll array<double>"


def host_of(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain (its last two labels) and last label; an address gives none."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    host = (m[1] if m else "").lower().rstrip(".")
    labels = host.split(".")
    suffix = labels[-1] if len(labels) > 1 and not labels[-1].isdigit() else ""
    return host, ".".join(labels[-2:]) if suffix else host, suffix


def _evidence(model: Texts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        for b in batches:
            rows = []
            for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                html = html.as_py() or ""
                total = np.zeros(n)
                for g in grams(plain(html)):
                    total += model.logp[g].sum(0, dtype=np.float64)
                ll = np.maximum((total - total.max(initial=-np.inf)) * WEIGHT, -BOUND) if n else total
                declared = declared_language(html)
                rows.append((i, *host_of(url), declared.lower() if declared else "", ll.tolist()))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in EVIDENCE.split(", ")])

    return run


def identify(pages: DataFrame, model: Texts, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = 4.0, host_strength: float = 2.0) -> DataFrame:
    """(page_id, host, declared, suffix, text_language, language, probability), one row a page.

    strength and host_strength are the numbers of pages that the level above counts for.
    """
    k = len(model.languages)
    base = Scratch(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_evidence(model), EVIDENCE), "language-evidence").read()
    if not k:
        return base.filter(F.lit(False)).select("page_id", "host", "declared", "suffix", F.lit("").alias("text_language"), F.lit("").alias("language"), F.lit(0.0).alias("probability"))
    # one value a language, in arrays, so that the plan is the same for any number of languages
    total_of = lambda x: F.expr(f"aggregate({x}, 0D, (a, b) -> a + b)")
    even = lambda df, x, out: df.withColumn(out, F.expr(f"transform({x}, x -> exp(x - greatest(array_max({x}), -1e300D)))")).withColumn(f"{out}_sum", total_of(out)).withColumn(out, F.expr(f"transform({out}, x -> x / {out}_sum)"))
    own = even(base, "ll", "q")
    found = {r.i: r.s for r in own.select(F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()}
    total = [found.get(i, 0.0) for i in range(k)]
    pages_n = max(sum(total), 1e-9)
    share = [(t + 1 / k) / (pages_n + 1) for t in total]

    def sums(key: str, mark: str) -> DataFrame:
        each = own.select(F.col(key).alias(f"{mark}_key"), F.posexplode("q").alias("i", "v")).groupBy(f"{mark}_key", "i").agg(F.sum("v").alias("s"))
        return each.groupBy(f"{mark}_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x.s).alias(mark))

    rows = own
    for key, mark in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        rows = rows.join(sums(key, mark), F.col(key) == F.col(f"{mark}_key"))
        rows = rows.withColumn(f"{mark}_less", F.expr(f"zip_with({mark}, q, (a, b) -> greatest(a - b, 0D))")).withColumn(f"{mark}_n", total_of(f"{mark}_less")).withColumn(f"{mark}_whole", total_of(mark))
    listed = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rows = rows.withColumn("share", listed(share)).withColumn("total", listed(total))
    domain = f"((d_less[i] + {strength} * share[i]) / (d_n + {strength}))"
    prior = f"((h_less[i] + {host_strength} * {domain}) / (h_n + {host_strength}))"
    # a value's probability given the language, smoothed by its share of all pages
    given = [f"(({m}_less[i] + {strength} * {m}_whole / {pages_n!r}D) / (total[i] + {strength}))" for m in ("s", "m")]
    rows = rows.withColumn("evidence", F.expr(f"transform(ll, (x, i) -> x + ln({prior}) + ln({given[0]}) + ln({given[1]}))"))
    scored = even(rows, "evidence", "p")
    languages = F.array(*[F.lit(x) for x in model.languages])
    best = lambda x: F.element_at(languages, F.array_position(x, F.array_max(x)).cast("int"))
    return scored.select("page_id", "host", "declared", "suffix", best("q").alias("text_language"), best("p").alias("language"), F.array_max("p").alias("probability"))
