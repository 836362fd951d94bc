"""Quality classifier (operator 8): a byte-level convolutional network in numpy.

Bytes are embedded and convolved by learned filters; the responses are max-pooled over
overlapping chunks that cover the whole document, and the mean and the maximum over the
chunks are combined into one probability.

Defined cases: a null or empty text is one chunk of zero bytes; unlabelled rows and labels
without a document don't train; with no label or labels of one kind the probability is
their share (0.5 for none). Repeated labels of a document count once, as their largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

CHUNK, HOP, WINDOW, STRIDE = 512, 448, 8, 4
EMBED, FILTERS = 6, 24
BATCH = 1 << 20


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (WINDOW * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,): mean over chunks, then maximum
    offset: float
    constant: float | None = None


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded bytes of all texts, the window at which each chunk starts, and each chunk's text.

    Windows start every STRIDE bytes; a chunk holds those that end within it, and the
    first of the next text start no earlier than after the last chunk of this one.
    """
    counts = np.array([max(1, -(-(len(t) - CHUNK) // HOP) + 1) for t in texts])
    room = counts * HOP + CHUNK - HOP
    flat = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, room.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat, (np.repeat(np.cumsum(room) - room, counts) + within * HOP) // STRIDE, owner


def responses(net: Network, flat: np.ndarray) -> np.ndarray:
    """Filter responses at every window, (windows, FILTERS)."""
    x = net.embed[flat]
    n = (len(flat) - WINDOW) // STRIDE + 1
    cols = np.lib.stride_tricks.as_strided(x, (n, WINDOW * EMBED), (STRIDE * EMBED * 4, 4), writeable=False)
    return cols @ net.conv


PER_CHUNK = (CHUNK - WINDOW) // STRIDE + 1


def pooled(r: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each chunk."""
    ends = np.minimum(starts + PER_CHUNK, len(r))
    index = np.column_stack((starts, ends)).ravel()
    if index[-1] >= len(r):
        index = index[:-1]
    return np.maximum.reduceat(r, index, axis=0)[::2]


def combine(net: Network, h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.searchsorted(owner, np.arange(n))
    counts = np.diff(np.append(first, len(owner)))[:, None]
    mean, top = np.add.reduceat(h, first, axis=0) / counts, np.maximum.reduceat(h, first, axis=0)
    v = np.concatenate((mean, top), 1)
    return v, v @ net.out + net.offset, counts


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    out, at = np.empty(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end]) + CHUNK
            end += 1
        flat, starts, owner = layout(texts[at:end])
        h = []
        # a very long text in pieces: windows of a piece reach into the next one
        step = BATCH // STRIDE
        if len(flat) <= 2 * BATCH:
            h.append(pooled(responses(net, flat), starts))
        else:
            for a in range(0, len(starts), step // PER_CHUNK):
                s = starts[a : a + step // PER_CHUNK]
                piece = flat[s[0] * STRIDE : s[-1] * STRIDE + CHUNK]
                h.append(pooled(responses(net, piece), s - s[0]))
        act = np.maximum(np.concatenate(h) + net.bias, 0)
        z = combine(net, act, owner, end - at)[1]
        out[at:end] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        at = end
    return out


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy; a maximum passes its gradient to the window that reached it."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WINDOW * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    if not len(labels) or labels.min() == labels.max():
        net.constant = 0.5 if not len(labels) else float(labels[0])
        return net
    share = labels.mean()
    params = [net.embed, net.conv, net.bias, net.out, np.array([np.log(share / (1 - share))], np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            idx = order[k : k + batch]
            net.offset = float(params[4][0])
            flat, starts, owner = layout([texts[i] for i in idx])
            r = responses(net, flat)
            cells = starts[:, None] + np.arange(PER_CHUNK)
            cells = np.minimum(cells, len(r) - 1)
            best = r[cells].argmax(1)  # (chunks, FILTERS)
            where = np.take_along_axis(cells, best, 1)
            top = r[where, np.arange(FILTERS)] + net.bias
            act = np.maximum(top, 0)
            vec, z, counts = combine(net, act, owner, len(idx))
            err = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - labels[idx]) / len(idx)
            g_out, g_off = vec.T @ err, err.sum()
            g_act = (err / counts[:, 0])[owner][:, None] * net.out[:FILTERS]
            is_top = act == vec[owner, FILTERS:]
            g_act = g_act + np.where(is_top, err[owner][:, None] * net.out[FILTERS:], 0)
            g_act = np.where(top > 0, g_act, 0).astype(np.float32)
            g_conv, g_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
            base = where * STRIDE
            for f in range(FILTERS):
                b = flat[base[:, f][:, None] + np.arange(WINDOW)]  # (chunks, WINDOW)
                g_conv[:, f] = g_act[:, f] @ net.embed[b].reshape(len(b), -1)
                w = net.conv[:, f].reshape(WINDOW, EMBED)
                np.add.at(g_embed, b, g_act[:, f][:, None, None] * w)
            t += 1
            lr = rate * (1 - epoch / epochs) ** 0.5
            for i, g in enumerate((g_embed, g_conv, g_act.sum(0), g_out + 1e-4 * net.out, np.array([g_off]))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= (lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.offset = float(params[4][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = 1500, longest: int = 65536, epochs: int = 12) -> Network:
    """A network from at most sample labelled rows outside fold 0, of texts up to longest bytes.

    Both bounds are parameters: they keep what comes to the driver under sample * longest
    bytes. Rows are taken in order of a hash of their id.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(id_col, folds) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    short = texts.select("id").join(known, "id", "left_semi").distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
    ids = [r.id for r in short.select("id").collect()]
    if not ids:
        return train([], np.zeros(0))
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "id long"))
    rows = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text")).join(known, "id").orderBy("id").collect()
    return train([r.text.encode() for r in rows], np.array([r.label for r in rows], np.float64), epochs=epochs)




class _Scores:
    """Scores only, so that a text doesn't come back from Python."""

    def __init__(self, net: Network):
        self.net = net

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(self.net, [(x.as_py() or "").encode() for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])


def probabilities(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row a row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_Scores(net), "id long, score double")


def keep(docs: DataFrame, net: Network, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches threshold; all columns stay."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(score(net, [(t or "").encode() for t in texts]))

    return docs.filter(quality(F.col(text_col)) >= threshold)
