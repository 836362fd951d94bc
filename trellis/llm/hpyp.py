"""LM scoring by a hierarchical Pitman-Yor model (operator 1).

A word's distribution after a context is a Pitman-Yor process whose base is the unigram
distribution, shared by all contexts, whose base in turn is uniform over the vocabulary
and one unknown word. A context is the previous word, by its 64-bit hash, with a restaurant of its own.
Customers are the word's occurrences; the tables of a dish in a context are the dish's
customers in the shared parent. Gibbs sampling draws the number of tables of each dish in
each restaurant from its conditional, given all other seats; dishes are dealt over tasks by
word, and the restaurants' numbers of tables are brought up to date after each sweep.
Predictive probabilities are averaged over the samples kept.

Everything that grows with the corpus stays in Spark: texts are read in chunks; a chunk
asks each part of the vocabulary once for each (word, context) it holds, with its counts,
and gets back their probabilities. Restaurants are dealt to parts by their hash as well: the
parts of the vocabulary send them their sums, and get back the totals of those they hold.
Only the levels' few totals come to the driver.

Defined cases: a null text is empty and scores its end alone; a null id counts as an empty
text in the choice of the held-out fold; rows that repeat count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, Scratch

CHUNK_TOKENS, PART_BYTES = 600_000, 12 << 20
#: Chunks are asked for and answered in two halves, by the tasks that read them: only one half's shuffles are on disk.
HALVES = 2
EXACT = 64
#: Hashed like words; neither can be one.
END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"")

REQUESTS = "part int, chunk long, mark long, words binary, sizes binary, contexts binary, places binary, counts binary"
TOKENS = "part int, chunk long, mark long, ids array<long>, lengths binary, pairs binary, sizes binary, known binary, logp binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def pack(x: np.ndarray, kind=np.uint32) -> bytes:
    """Numbers with their equal bytes side by side, compressed: most are small."""
    return zlib.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind=np.uint32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def home(contexts: np.ndarray, parts: int) -> np.ndarray:
    """The part of each context's restaurant; it grows with the hash."""
    return ((contexts >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Some documents' tokens, as indices of the chunk's distinct (word, context) pairs.

    Pairs are in order of (part of the word, hash of the word, hash of the context); `at` is
    a pair's place among the chunk's contexts, which are in order of their hashes.
    """

    def __init__(self, ids: list, tokens: list[list[bytes]], parts: int, folds: int):
        self.ids, seen = ids, {}
        self.lengths = np.array([len(t) + 1 for t in tokens])
        ends = np.cumsum(self.lengths)
        flat = np.zeros(int(ends[-1]), np.int64)
        body = np.ones(len(flat), bool)
        body[ends - 1] = False
        flat[body] = np.fromiter((seen.setdefault(w, len(seen)) for t in tokens for w in t), np.int64, int(body.sum()))
        flat[~body] = len(seen)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
        hashes = np.append(hashes, np.uint64(END))
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((hashes, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.part = hashes[order], part[order]
        before = np.empty(len(flat), np.int64)
        self.contexts, place = np.unique(np.append(hashes, np.uint64(START)), return_inverse=True)
        before[1:] = place[flat[:-1]]
        before[0], before[ends[:-1]] = place[-1], place[-1]
        code, self.pairs = np.unique(rank[flat] << 32 | before, return_inverse=True)
        self.at = code & 0xFFFFFFFF
        self.sizes = np.bincount(code >> 32, minlength=len(order))
        train = np.repeat([not held_out(i, folds) for i in ids], self.lengths)
        self.counts = np.bincount(self.pairs[train], minlength=len(code)).astype(np.uint32)
        self.mark = int((self.words.sum() ^ np.uint64(len(code))).astype(np.int64))


def chunks(batches: Iterator[pa.RecordBatch], parts: int, folds: int) -> Iterator[tuple[int, Chunk]]:
    """Chunks of a task's documents, with ids that a second reading finds again."""
    base, n, ids, tokens, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for b in batches:
        for i, text in zip(b.column(0), b.column(1), strict=True):
            words = (text.as_py() or "").encode().lower().split()
            ids.append(i.as_py())
            tokens.append(words)
            size += len(words) + 1
            if size >= CHUNK_TOKENS:
                yield base + n, Chunk(ids, tokens, parts, folds)
                n, ids, tokens, size = n + 1, [], [], 0
    if ids:
        yield base + n, Chunk(ids, tokens, parts, folds)


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _requests(parts: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, c in chunks(batches, parts, folds):
            at = np.concatenate(([0], np.cumsum(c.sizes)))
            edges = np.searchsorted(c.part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a < b:
                    held, place = np.unique(c.at[at[a] : at[b]], return_inverse=True)
                    rows.append((p, cid, c.mark, c.words[a:b].tobytes(), c.sizes[a:b].astype(np.uint32).tobytes(), c.contexts[held].tobytes(), pack(place), pack(c.counts[at[a] : at[b]])))
            yield _batch(REQUESTS, list(zip(*rows, strict=True)))

    return run


def _tokens(parts: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, c in chunks(batches, parts, folds):
            yield _batch(TOKENS, [[-1], [cid], [c.mark], [c.ids], [c.lengths.astype(np.uint32).tobytes()], [pack(c.pairs)], [c.sizes.astype(np.uint32).tobytes()], [None], [None]])

    return run


# --- one part of the vocabulary ---

PART = "part int, tokens long, types long, pairs long, words binary, sizes binary, contexts array<binary>, places binary, counts binary, ctx_customers array<binary>, ctx_tables array<binary>, ones long, twos long"
SLOTS = "part int, home int, slots binary, customers binary, tables binary"
TOTALS = "part int, home int, tables binary"


def _read(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]


def _deal(contexts: np.ndarray, values: np.ndarray, parts: int) -> list[np.ndarray]:
    """Values of sorted contexts, cut by the parts of their restaurants."""
    return np.split(values, np.searchsorted(home(contexts, parts), np.arange(1, parts)))


def _merge(parts: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Training counts of all (word, context) of a part, from its requests; contexts that are only asked for are listed too."""
        t = pa.concat_tables([x for x in (left, right) if x.num_rows])
        words, sizes, contexts = (_read(t, n, d) for n, d in (("words", np.uint64), ("sizes", np.uint32), ("contexts", np.uint64)))
        counts, places = ([unpack(x.as_py()) for x in t.column(n)] for n in ("counts", "places"))
        have = np.unique(np.concatenate(contexts))
        vocab, where = np.unique(np.concatenate(words), return_inverse=True)
        code = np.repeat(where, np.concatenate(sizes)) << 32
        code |= np.concatenate([np.searchsorted(have, c)[k] for c, k in zip(contexts, places, strict=True)])
        n = np.concatenate(counts).astype(np.int64)
        code, n = code[n > 0], n[n > 0]
        pair, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, n, len(pair)).astype(np.int64)
        used = np.unique(pair >> 32)
        size = np.bincount(np.searchsorted(used, pair >> 32), minlength=len(used))
        ctx = pair & 0xFFFFFFFF
        sums = [[pack(x, np.uint64) for x in _deal(have, np.bincount(ctx, w, len(have)), parts)] for w in (n, None)]
        row = [[key[0].as_py()], [int(n.sum())], [len(used)], [len(pair)], [vocab[used].tobytes()], [size.astype(np.uint32).tobytes()], [[x.tobytes() for x in _deal(have, have, parts)]], [pack(ctx)], [pack(n, np.uint64)], [sums[0]], [sums[1]], [int((n == 1).sum())], [int((n == 2).sum())]]
        return pa.Table.from_batches([_batch(PART, row)])

    return run


# --- the restaurants, by the part of their hash ---


def _total(slots: list[np.ndarray], values: list[np.ndarray]) -> list[bytes]:
    """The sums over all senders of each sender's restaurants."""
    flat = np.concatenate(slots).astype(np.int64)
    total = np.bincount(flat, np.concatenate(values)).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    return [pack(total[k], np.uint64) for k in slots]


def _slots(key: tuple, t: pa.Table) -> pa.Table:
    """Where each part's contexts stand among a home's restaurants, and their customers and first tables."""
    contexts = _read(t, "contexts", np.uint64)
    have = np.unique(np.concatenate(contexts))
    slots = [np.searchsorted(have, c) for c in contexts]
    sums = [_total(slots, [unpack(x.as_py(), np.uint64) for x in t.column(n)]) for n in ("customers", "tables")]
    return pa.Table.from_batches([_batch(SLOTS, [t.column("part").to_pylist(), t.column("home").to_pylist(), [pack(k) for k in slots], *sums])])


def _retotal(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Tables of each part's restaurants after a sweep."""
    sent = dict(zip(right.column("part").to_pylist(), right.column("tables").to_pylist(), strict=True))
    part = left.column("part").to_pylist()
    slots = [unpack(x.as_py()) for x in left.column("slots")]
    return pa.Table.from_batches([_batch(TOTALS, [part, left.column("home").to_pylist(), _total(slots, [unpack(sent[p], np.uint64) for p in part])])])


def _gathered(t: pa.Table, name: str, rows: list[int]) -> np.ndarray:
    """A part's totals from all homes, in order of its contexts."""
    homes = t.column("home").to_pylist()
    return np.concatenate([unpack(t.column(name)[k].as_py(), np.uint64) for k in sorted(rows, key=homes.__getitem__)]).astype(np.int64)


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: ways to seat c customers at t tables, weighted."""
    s = np.zeros((most + 1, most + 1))
    s[1, 1] = 1
    for c in range(2, most + 1):
        t = np.arange(1, c + 1)
        s[c, t] = s[c - 1, t - 1] + (c - 1 - d * t) * s[c - 1, t]
    with np.errstate(divide="ignore"):
        return np.log(s)


def sample_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with c customers each, drawn given the others' tables.

    p: the parent's probability of the dish; others: tables of other dishes in its restaurant.
    Up to EXACT customers the draw is from the exact conditional, S(c, t) p^t prod(theta + d (others + k));
    above, customers are seated in turn, in runs over which the chance of a new table is held.
    """
    t = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    values, starts = np.unique(c[order], return_index=True)
    for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
        if v < 2 or v > EXACT:
            continue
        for k in range(a, b, max(1, (1 << 20) // v)):
            rows = order[k : min(b, k + max(1, (1 << 20) // v))]
            steps = np.log(theta + d * (others[rows, None] + np.arange(v))) + np.log(p[rows])[:, None]
            w = np.cumsum(steps, 1) + log_s[v, 1 : v + 1]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            t[rows] = 1 + (w < rng.random(len(rows))[:, None] * w[:, -1:]).sum(1)
    big = order[np.searchsorted(c[order], EXACT, side="right") :]
    if big.size:
        n, a, seated, now = c[big], (theta + d * others[big]) * p[big], 1, np.ones(len(big), np.int64)
        while True:
            live = n > seated
            if not live.any():
                break
            run = np.minimum(max(1, seated // 16), n[live] - seated)
            new = rng.binomial(run, np.clip(a[live] / (a[live] + seated - d * now[live]), 0, 1))
            now[live] += np.minimum(new, run)
            seated += max(1, seated // 16)
        t[big] = np.minimum(now, n)
    return t


class Model:
    """The totals that all parts share, those of some restaurants (none but in a part), and the levels' parameters."""

    def __init__(self, tokens: int, types: int, customers: np.ndarray | None, tables: np.ndarray | None, d: float, theta: float, root_customers: int, root_tables: int, d_root: float, theta_root: float):
        self.tokens, self.types, self.customers, self.tables = tokens, types, customers, tables
        self.d, self.theta, self.root_customers, self.root_tables, self.d_root, self.theta_root = d, theta, root_customers, root_tables, d_root, theta_root

    def at(self, customers: np.ndarray | None, tables: np.ndarray) -> Model:
        """The model with the totals of a part's restaurants."""
        return Model(self.tokens, self.types, customers, tables, self.d, self.theta, self.root_customers, self.root_tables, self.d_root, self.theta_root)

    @property
    def uniform(self) -> float:
        return 1 / (self.types + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Unigram probabilities of words with these seats in the shared parent."""
        return (np.maximum(customers - self.d_root * tables, 0) + (self.theta_root + self.d_root * self.root_tables) * self.uniform) / (self.theta_root + self.root_customers)

    def after(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.d * t, 0) + (self.theta + self.d * self.tables[ctx]) * parent) / (self.theta + self.customers[ctx])


SEATS = "part int, tables binary, root binary, ctx_tables array<binary>, root_customers long, root_tables long, root_ones long, root_twos long"


def _sweep(shared: Model, sweep: int, seed: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_batch(SEATS, [[] for _ in SEATS.split(", ")]).schema)
        part = key[0].as_py()
        rng = np.random.default_rng([seed, sweep, part])
        size, have = _read(left, "sizes", np.uint32)[0], [len(x) // 8 for x in left.column("contexts")[0].as_py()]
        ctx, c = (unpack(left.column(n)[0].as_py(), d).astype(np.int64) for n, d in (("places", np.uint32), ("counts", np.uint64)))
        word = np.repeat(np.arange(len(size)), size)
        homes = right.column("home").to_pylist()
        model = shared.at(None, _gathered(right, "tables", [k for k, h in enumerate(homes) if h >= 0]))
        if -1 in homes:
            t, root = (unpack(right.column(n)[homes.index(-1)].as_py()).astype(np.int64) for n in ("tables", "root"))
        else:
            t, root = np.ones(len(c), np.int64), np.ones(len(size), np.int64)
        below = np.bincount(word, t, len(size)).astype(np.int64)
        p = model.parent(below, root)[word]
        t = sample_tables(c, p, np.maximum(model.tables[ctx] - t, 0), model.d, model.theta, stirling(model.d), rng)
        below = np.bincount(word, t, len(size)).astype(np.int64)
        root = sample_tables(below, np.full(len(size), model.uniform), np.maximum(model.root_tables - root, 0), model.d_root, model.theta_root, stirling(model.d_root), rng)
        sums = np.split(np.bincount(ctx, t, sum(have)), np.cumsum(have)[:-1])
        return pa.Table.from_batches([_batch(SEATS, [[part], [pack(t)], [pack(root)], [[pack(x, np.uint64) for x in sums]], [int(below.sum())], [int(root.sum())], [int((below == 1).sum())], [int((below == 2).sum())]])])

    return run


def _answers(models: list[Model]):
    """(request, part, its samples) -> log10 probabilities of the pairs, log10 of the smoothed counts of the words."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if left.num_rows and right.num_rows:
            rows_of: dict[tuple, list[int]] = {}
            for k, (x, h) in enumerate(zip(right.column("sample").to_pylist(), right.column("home").to_pylist(), strict=True)):
                rows_of.setdefault((x, h >= 0), []).append(k)
            one = rows_of[-1, False][0]
            vocab, size = (np.frombuffer(right.column(n)[one].as_py(), d) for n, d in (("words", np.uint64), ("sizes", np.uint32)))
            have = np.frombuffer(b"".join(right.column("contexts")[one].as_py()), np.uint64)
            ctx, c = (unpack(right.column(n)[one].as_py(), d) for n, d in (("places", np.uint32), ("counts", np.uint64)))
            customers = _gathered(right, "customers", rows_of[-1, True])
            local = [m.at(customers, _gathered(right, "tables", rows_of[s, True])) for s, m in enumerate(models)]
            seats = [tuple(unpack(right.column(n)[rows_of[s, False][0]].as_py()) for n in ("tables", "root")) for s in range(len(models))]
            del right
        elif left.num_rows:
            raise RuntimeError("a part of the vocabulary has requests but no counts")
        else:
            return pa.Table.from_batches([_batch(TOKENS, [[] for _ in TOKENS.split(", ")])])
        word = np.repeat(np.arange(len(size)), size)
        pair = word << 32 | ctx
        total = np.bincount(word, c, len(size)).astype(np.int64)
        parents = [m.parent(np.bincount(word, t, len(size)), root) for m, (t, root) in zip(models, seats, strict=True)]
        del word, ctx
        rows = []
        for k in range(left.num_rows):
            words, sizes, contexts = (np.frombuffer(left.column(n)[k].as_py(), d) for n, d in (("words", np.uint64), ("sizes", np.uint32), ("contexts", np.uint64)))
            asked = np.searchsorted(have, contexts)[unpack(left.column("places")[k].as_py())]
            at = np.minimum(np.searchsorted(vocab, words), max(len(vocab) - 1, 0))
            known = vocab[at] == words if len(vocab) else np.zeros(len(words), bool)
            who = np.repeat(at, sizes)
            ask = who << 32 | asked
            j = np.minimum(np.searchsorted(pair, ask), max(len(pair) - 1, 0))
            hit = (pair[j] == ask) & np.repeat(known, sizes) if len(pair) else np.zeros(len(ask), bool)
            mean = np.zeros(len(ask))
            for m, (t, _), p in zip(local, seats, parents, strict=True):
                parent = np.where(known, p[at], m.parent(np.zeros(1), np.zeros(1))) if len(vocab) else np.repeat(m.parent(np.zeros(1), np.zeros(1)), len(words))
                cc, tt = (np.where(hit, c[j], 0), np.where(hit, t[j], 0)) if len(pair) else (0, 0)
                mean += m.after(asked, cc, tt, np.repeat(parent, sizes)) / len(models)
            n = np.where(known, total[at], 0) if len(vocab) else np.zeros(len(words), np.int64)
            rows.append((part, left.column("chunk")[k].as_py(), left.column("mark")[k].as_py(), None, None, None, None, pack(n, np.int64), np.log10(mean).astype(np.float32).tobytes()))
        return pa.Table.from_batches([_batch(TOKENS, list(zip(*rows, strict=True)) or [[] for _ in range(9)])])

    return run


def _score(folds: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        part = t.column("part").to_numpy()
        order = np.argsort(part)
        head, rest = order[0], order[1:]
        if part[head] != -1 or len(set(t.column("mark").to_pylist())) != 1:
            raise RuntimeError("two readings of the documents were dealt differently to tasks")
        get = lambda n, k, d: np.frombuffer(t.column(n)[int(k)].as_py(), d)
        ids = t.column("ids")[int(head)].as_py()
        lengths, sizes = get("lengths", head, np.uint32).astype(np.int64), get("sizes", head, np.uint32)
        pairs = unpack(t.column("pairs")[int(head)].as_py())
        logp, n = np.concatenate([get("logp", k, np.float32) for k in rest]).astype(np.float64), np.concatenate([unpack(t.column("known")[int(k)].as_py(), np.int64) for k in rest])
        of_pair = np.repeat(n, sizes)
        starts = np.cumsum(lengths) - lengths
        take = of_pair[pairs]
        total = lambda x: np.add.reduceat(x, starts)
        return pa.Table.from_batches([_batch(SCORES, [ids, [held_out(i, folds) for i in ids], lengths.tolist(), total((take > 0).astype(np.int64)), total(np.log10(take + 0.1)), total(logp[pairs])])])

    return run


def _discount(ones: int, twos: int) -> float:
    """The leave-one-out estimate of Kneser and Ney, kept off its ends."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones + twos else 0.5))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, theta: float = 1.0, burn_in: int = 1, samples: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    # a half holds the rows of every second task that reads
    half = [rows.filter(F.spark_partition_id() % HALVES == k) for k in range(HALVES)]
    # bucketed by part, so that later passes need no shuffle of requests
    buckets = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = [Buckets(r.mapInArrow(_requests(parts, folds), REQUESTS).repartition(buckets, "part"), "part", buckets, "hpyp-requests") for r in half]
    left, right = (a.read().groupBy("part") for a in asked)
    counted = Scratch(left.cogroup(right).applyInArrow(_merge(parts), PART), "hpyp-counts").read()
    g = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "pairs", "ones", "twos")]).first()
    by_home = lambda df, *names: df.select("part", F.posexplode(F.arrays_zip(*names)).alias("home", "z")).select("part", "home", "z.*")
    sent = by_home(counted, "contexts", "ctx_customers", "ctx_tables").withColumnsRenamed({"ctx_customers": "customers", "ctx_tables": "tables"})
    slots = Scratch(sent.groupBy("home").applyInArrow(_slots, SLOTS), "hpyp-contexts").read()
    d = _discount(g.ones, g.twos)
    model = Model(g.tokens, g.types, None, None, d, theta, g.pairs, g.types, 0.5, theta)
    slim = counted.select("part", "sizes", "contexts", "places", "counts")
    totals, seats, last, kept = slots.select("part", "home", "tables"), None, None, []
    for sweep in range(burn_in + samples):
        before = totals if seats is None else totals.unionByName(seats.select("part", F.lit(-1).alias("home"), "tables", "root"), allowMissingColumns=True)
        made = Scratch(slim.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(_sweep(model, sweep, seed), SEATS), "hpyp-seats")
        now = made.read()
        summed = Scratch(slots.select("part", "home", "slots").groupBy("home").cogroup(by_home(now, "ctx_tables").withColumnRenamed("ctx_tables", "tables").groupBy("home")).applyInArrow(_retotal, TOTALS), "hpyp-totals")
        if last is not None and sweep <= burn_in:
            for x in last:
                x.drop()  # no sample that is kept
        totals, seats, last = summed.read(), now, (made, summed)
        r = seats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("root_customers", "root_tables", "root_ones", "root_twos")]).first()
        model = Model(g.tokens, g.types, None, None, d, theta, r.root_customers, r.root_tables, _discount(r.root_ones, r.root_twos), theta)
        if sweep >= burn_in:
            at = F.lit(sweep - burn_in).alias("sample")
            kept.append((model, seats.select("part", at, F.lit(-1).alias("home"), "tables", "root").unionByName(totals.select("part", at, "home", "tables"), allowMissingColumns=True)))
    # one row of counts a part and one a sample, and from each home the totals of the part's restaurants
    right = counted.select("part", F.lit(-1).alias("sample"), F.lit(-1).alias("home"), "words", "sizes", "contexts", "places", "counts", F.lit(None).cast("binary").alias("tables"), F.lit(None).cast("binary").alias("root"))
    right = right.unionByName(slots.select("part", F.lit(-1).alias("sample"), "home", "customers"), allowMissingColumns=True)
    for _, s in kept:
        right = right.unionByName(s, allowMissingColumns=True)
    out = []
    for r, a in zip(half, asked, strict=True):
        answers = a.read().groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_answers([m for m, _ in kept]), TOKENS)
        told = r.mapInArrow(_tokens(parts, folds), TOKENS).unionByName(answers)
        out.append(Scratch(told.groupBy("chunk").applyInArrow(_score(folds), SCORES), "hpyp-scores", result=True).read())
        a.drop()
    out = reduce(DataFrame.unionByName, out)
    norm = float(np.log10(g.tokens + 0.1 * (g.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(g.tokens).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * norm).alias("base_score"), "score")


def perplexity(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """(held_out, n_tokens, perplexity) of scored documents."""
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum(score_col) / F.sum("n_tokens")).alias("perplexity"))
