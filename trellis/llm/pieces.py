"""SentencePiece encoding and decoding by a relational lattice (operator 9).

Texts are cut into units that no piece crosses: before a run of spaces, around a line end,
and between characters that stand side by side in no piece. The distinct units of the corpus become rows;
their substrings up to the longest piece are exploded and joined to the piece table, the
edges are grouped by unit, and a Viterbi fold with the aggregate function picks the path of the
largest sum of scores, whatever the type of the model. Characters without a piece fall back to
byte pieces. Texts are cut once, in chunks of documents that list their distinct units; the
chunks join the table of units and put their documents together.

The ids that a BPE model's own library gives come from merges, which is another path for about
half of the distinct units; merges=True makes those over the same lattice.

Defined cases: a null text has null ids; an empty one has none. Rows that repeat, in id or text,
are rows of their own; a null id stays null; other columns are not read. U+2581 in a text decodes to
a space, as in the format itself; `intact` tells. A unit of more than UNIT characters is not folded in
SQL, whose time grows with the square of its length: the same path is found over the whole
unit in Python, in one pass. One text is never split over chunks: places of its words are in one worker's memory.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, Scratch, setting

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT, LEAD = 512, 3
#: Words of a chunk and about their bytes, units of a task, units packed at once, units of a chunk that are put together at once.
CHUNK_WORDS, CHUNK_BYTES, TASK_UNITS, PACK_UNITS, BLOCK, SLICE = 3_000_000, 16 << 20, 50_000, 500_000, 200_000, 20_000


@dataclass
class Pieces:
    """The piece table of a model: texts and scores of normal pieces, ids of byte pieces."""

    texts: dict[str, tuple[int, float]]
    bytes_at: list[int]
    decoded: list[bytes]  # by id; empty for control pieces

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.texts), default=1)

    @cached_property
    def fallback(self) -> float:
        return min((s for _, s in self.texts.values()), default=0.0) - 10

    def breaks(self) -> str:
        """Line ends and tabs that are in no piece of several characters."""
        return "".join(c for c in "\n\r\t" if not any(c in t for t in self.texts if len(t) > 1))


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, bytes_at, decoded = {}, [-1] * 256, []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            decoded.append(b"")
        else:
            texts[piece] = (i, m.get_score(i))
            decoded.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in t.lstrip(SPACE) for t in texts):
        raise ValueError("a piece goes on after a space; units can't be cut at spaces")
    return Pieces(texts, bytes_at, decoded)


class Cutter:
    """Cuts texts into words and words into units. No piece holds two characters between which a cut is, so no path crosses one."""

    def __init__(self, pieces: Pieces):
        stop = re.escape(pieces.breaks())
        self.find = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+|[{stop}]" if stop else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.plain = "\n" in stop
        chars = sorted({c for t in pieces.texts for c in t})
        #: A small number for each character of a piece, 0 for the rest; and which pairs of them are in a piece.
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pair = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in pieces.texts:
            n = self.number[[ord(c) for c in t]]
            self.pair[n[:-1], n[1:]] = True

    def words(self, text: str) -> list[str]:
        """Words of a text; empty ones count for nothing."""
        if not text:
            return []
        if "  " in text or SPACE in text or not self.plain:
            return self.find(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")  # the same words by plain splits

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Units of all words, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.number[flat]
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = ~self.pair[n[:-1], n[1:]]
        starts = np.cumsum(lengths) - lengths
        cut[starts[lengths > 0]] = True
        edges = np.flatnonzero(cut)
        counts = np.searchsorted(edges, starts + lengths) - np.searchsorted(edges, starts)
        whole = "".join(words)
        e = edges.tolist()
        return [whole[x:y] for x, y in zip(e, e[1:], strict=False)], counts

    def __call__(self, text: str) -> list[str]:
        return self.units(self.words(text))[0] if text else []


def cutter(pieces: Pieces) -> Cutter:
    return Cutter(pieces)


def best_path(unit: str, pieces: Pieces) -> list[int]:
    """Viterbi in plain Python, for long units and tests; of equally good paths the one with the longest last piece wins."""
    best = [(0.0, 0, [])] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - pieces.longest), e):
            got = pieces.texts.get(unit[s:e])
            if got is None and e - s > 1:
                continue
            ids = [got[0]] if got else [pieces.bytes_at[b] for b in unit[s:e].encode()]
            cand = best[s][0] + (got[1] if got else pieces.fallback)
            if best[e] is None or cand > best[e][0]:
                best[e] = (cand, s, ids)
    out, at = [], len(unit)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


def merged(unit: str, pieces: Pieces) -> list[int]:
    """The merges of merge_units in plain Python: a heap of the pairs of neighbours, and links between the parts left."""
    n = len(unit)
    before, after, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []  # score, start and end of a join; one is stale when its parts have changed

    def offer(s: int) -> None:
        if s >= 0 and after[s] >= 0 and (got := pieces.texts.get(unit[s : end[after[s]]])):
            heapq.heappush(heap, (-got[1], s, end[after[s]]))

    for s in range(n):
        offer(s)
    while heap:
        _, s, e = heapq.heappop(heap)
        if end[s] < 0 or after[s] < 0 or end[after[s]] != e:
            continue
        gone = after[s]
        end[s], end[gone], after[s] = e, -1, after[gone]
        if after[s] >= 0:
            before[after[s]] = s
        offer(before[s])
        offer(s)
    out, s = [], 0
    while 0 <= s < n:
        got = pieces.texts.get(unit[s : end[s]])
        out += [got[0]] if got else [pieces.bytes_at[b] for b in unit[s].encode()]
        s = after[s]
    return out


def long_units(units: DataFrame, pieces: Pieces, merges: bool = False) -> DataFrame:
    """(unit, ids) of units too long for the fold, each whole."""
    one = merged if merges else best_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.column(0):
                u = unit.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([u], pa.string()), pa.array([one(u, pieces)], pa.list_(pa.int32()))], ["unit", "ids"])

    return units.mapInArrow(run, "unit string, ids array<int>")


def spans_of(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The lattice of distinct units (column unit): (unit, s, e, piece, id, rank), id null for a character without a piece.

    Substrings are bounded by the longest piece that begins with the same LEAD characters.
    """
    order = {x: k for k, x in enumerate(sorted({x for _, x in pieces.texts.values()}, reverse=True))}
    far: dict[str, int] = {}
    for t in pieces.texts:
        if len(t) >= LEAD:
            far[t[:LEAD]] = max(len(t), far.get(t[:LEAD], 0))
    # the tables of a model: tens of thousands of short rows, whatever the corpus
    table = units.sparkSession.createDataFrame([(t, i, order[x]) for t, (i, x) in pieces.texts.items()], "piece string, id int, rank int")
    reach = units.sparkSession.createDataFrame(list(far.items()), "lead string, far int")
    starts = units.filter(F.length("unit") > 0).select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    starts = starts.withColumn("lead", F.expr(f"substring(unit, s + 1, {LEAD})")).join(F.broadcast(reach), "lead", "left")
    spans = (
        starts.select("unit", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.length("unit"), F.col("s") + F.coalesce("far", F.lit(LEAD - 1))))).alias("e"))
        .withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    )
    return spans.join(F.broadcast(table), "piece", "left").filter("id is not null or e = s + 1")


def _bytes_of(start: str) -> str:
    """SQL: byte pieces of the unit's character at a start."""
    ch = f"substring(unit, {start} + 1, 1)"
    return f"transform(sequence(1, octet_length({ch})), k -> element_at(bytes_at, cast(conv(substring(hex({ch}), 2 * k - 1, 2), 16, 10) as int) + 1))"


def merge_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) by merges: of the pairs of neighbours whose join is a piece the best by score, the first of equals, becomes one, again and again.

    The fold's state is the borders between the unit's parts; a merge takes one out. An edge
    is one long: its rank, start, end and id.
    """
    edges = spans_of(units, pieces).select("unit", F.expr("case when id is not null then shiftleft(cast(rank as bigint), 41) | shiftleft(cast(s as bigint), 31) | shiftleft(cast(e as bigint), 20) | id end").alias("edge"))
    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges")).withColumn("bytes_at", F.split(F.lit(",".join(map(str, pieces.bytes_at))), ",").cast("array<int>"))
    s, e, i = (lambda x: f"cast(shiftright({x}, 31) & 1023 as int)"), (lambda x: f"cast(shiftright({x}, 20) & 2047 as int)"), (lambda x: f"cast({x} & 1048575 as int)")
    # state: the borders, and the edges of several characters whose ends are borders, the best first
    merge = f"""
      aggregate(if(length(unit) > 1, sequence(1, length(unit) - 1), cast(array() as array<int>)),
        struct(sequence(0, length(unit)) as b, filter(edges, x -> {e("x")} > {s("x")} + 1) as g),
        (a, k) -> if(size(a.g) = 0, a, element_at(transform(array(get(filter(a.g, x -> array_position(a.b, {e("x")}) = array_position(a.b, {s("x")}) + 2), 0)),
          y -> if(y is null, struct(a.b as b, cast(array() as array<bigint>) as g),
            element_at(transform(array(element_at(a.b, cast(array_position(a.b, {s("y")}) as int) + 1)),
              m -> struct(array_remove(a.b, m) as b, filter(a.g, x -> {s("x")} <> m and {e("x")} <> m and x <> y) as g)), 1))), 1)),
        a -> a.b)"""
    spelled = f"""
      flatten(transform(slice(b, 1, size(b) - 1), (p, j) -> element_at(transform(array(get(edges, cast(array_position(places, p * 2048 + element_at(b, j + 2)) as int) - 1)),
        y -> if(y is null, {_bytes_of("p")}, array({i("y")}))), 1)))"""
    placed = grouped.withColumn("places", F.expr("transform(edges, x -> cast(shiftright(x, 20) & 2097151 as int))"))
    return placed.withColumn("b", F.expr(merge)).select("unit", F.expr(spelled).alias("ids"))


def encode_units(units: DataFrame, pieces: Pieces, merges: bool = False) -> DataFrame:
    """(unit, ids) of distinct units (column unit, dealt by it): lattice, join, grouping and fold."""
    short, long = units.filter(F.length("unit") <= UNIT), units.filter(F.length("unit") > UNIT)
    return (merge_units if merges else viterbi_units)(short, pieces).unionByName(long_units(long, pieces, merges))


def viterbi_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of the best path by sums of scores; of equally good ones that with the longest last piece, and so on backwards."""
    found = spans_of(units, pieces)
    # an edge is one long: its end, its start, and its piece plus one; 0 is a character without a piece
    edges = found.select("unit", F.expr("shiftleft(cast(e as bigint), 48) | shiftleft(cast(s as bigint), 32) | coalesce(id + 1, 0)").alias("edge"))
    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    by_id = [pieces.fallback] + [0.0] * len(pieces.decoded)
    for i, score in pieces.texts.values():
        by_id[i + 1] = float(score)
    grouped = grouped.withColumn("scores", F.split(F.lit(",".join(map(repr, by_id))), ",").cast("array<double>"))
    # state: scores and best edges of the ends so far, and the end in work; edges come by end, then start
    step = """
      aggregate(edges,
        struct(array(0D) as score, cast(array() as array<bigint>) as edge, 0 as e, 0D as best, 0L as now),
        (a, x) -> if(cast(shiftright(x, 48) as int) = a.e,
          if(element_at(a.score, cast(shiftright(x, 32) & 65535 as int) + 1) + element_at(scores, cast(x & 4294967295 as int) + 1) > a.best,
            struct(a.score as score, a.edge as edge, a.e as e, element_at(a.score, cast(shiftright(x, 32) & 65535 as int) + 1) + element_at(scores, cast(x & 4294967295 as int) + 1) as best, x as now),
            a),
          if(a.e = 0,
            struct(a.score as score, a.edge as edge, cast(shiftright(x, 48) as int) as e, element_at(scores, cast(x & 4294967295 as int) + 1) as best, x as now),
            struct(array_append(a.score, a.best) as score, array_append(a.edge, a.now) as edge, cast(shiftright(x, 48) as int) as e,
                   element_at(array_append(a.score, a.best), cast(shiftright(x, 32) & 65535 as int) + 1) + element_at(scores, cast(x & 4294967295 as int) + 1) as best, x as now))),
        a -> array_append(a.edge, a.now))"""
    back = """
      aggregate(sequence(size(v), 1), struct(size(v) as at, cast(array() as array<bigint>) as path),
        (a, k) -> if(k = a.at, struct(cast(shiftright(element_at(v, k), 32) & 65535 as int) as at, array_prepend(a.path, element_at(v, k)) as path), a),
        a -> a.path)"""
    at = ",".join(map(str, pieces.bytes_at))
    spelled = """
      flatten(transform(path, x -> if(x & 4294967295 > 0, array(cast(x & 4294967295 as int) - 1),
        @bytes)))""".replace("@bytes", _bytes_of("cast(shiftright(x, 32) & 65535 as int)"))
    paths = grouped.select("unit", F.expr(step).alias("v")).select("unit", F.expr(back).alias("path"))
    return paths.withColumn("bytes_at", F.split(F.lit(at), ",").cast("array<int>")).select("unit", F.expr(spelled).alias("ids"))


class Chunk:
    """Some documents' units as places among the chunk's distinct units."""

    def __init__(self, cut: Cutter, words: dict[str, int], first: list[np.ndarray]):
        """words: the distinct words; first: for each document where in the chunk each of its words came first; it is emptied."""
        # some words at a time, so that only distinct units are held as texts
        place, found = {}, []
        rest = iter(words)
        while some := list(islice(rest, SLICE)):
            units, n = cut.units(some)
            found.append((np.fromiter((place.setdefault(u, len(place)) for u in units), np.int64, len(units)), n))
        of_word, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        names = sorted(place)
        alphabetic = np.empty(len(names), np.int64)
        alphabetic[np.fromiter(map(place.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        of_word = alphabetic[of_word]
        at = np.concatenate(first)
        del words, place, found
        first_at = np.flatnonzero(at == np.arange(len(at), dtype=np.uint32)).astype(np.uint32)  # of each distinct word
        ends = np.cumsum([len(x) for x in first])
        first.clear()
        blocks = range(0, len(at), BLOCK)
        for k in blocks:
            at[k : k + BLOCK] = np.searchsorted(first_at, at[k : k + BLOCK])
        # the more frequent ones get the smaller places, so that places compress well; within a power of two they stay in order
        seen = np.zeros(len(counts), np.int64)
        for k in blocks:
            seen += np.bincount(at[k : k + BLOCK], minlength=len(seen))
        often = np.bincount(of_word, np.repeat(seen, counts), len(names))
        order = np.argsort(-np.floor(np.log2(often)), kind="stable")
        self.units, rank = [names[k] for k in order.tolist()], np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        of_word, begin, counts = rank[of_word], np.cumsum(counts) - counts, counts.astype(np.int32)
        long = [counts[at[k : k + BLOCK]].sum(dtype=np.int64) for k in blocks]
        self.flat, upto, edge = np.empty(sum(long), np.uint32), np.zeros(len(ends), np.int64), 0
        for k, n in zip(blocks, long, strict=True):
            x = at[k : k + BLOCK]
            self.flat[edge : edge + n] = _gather(begin[x], counts[x], of_word)
            a, b = np.searchsorted(ends, (k, k + len(x)), side="right")  # texts that end in this block
            upto[a:b] = edge + np.cumsum(counts[x])[ends[a:b] - k - 1]
            edge += n
        self.lengths = np.diff(upto, prepend=0)


def pack(x: np.ndarray) -> bytes:
    """Numbers with their equal bytes side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


#: Texts that go to a worker at once; a batch of the usual size holds a whole split's, in both processes.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000")
CHUNKS = "chunk long, doc_ids array<long>, sums array<long>, lengths binary, flat binary, units array<string>"
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string())]
OUT = "doc_id long, n_tokens long, ids array<int>, intact boolean"


def _chunks(pieces: Pieces):
    """One row a chunk: its documents, their units as places, and the distinct units. Documents without words end a chunk by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, base, n, rows, sums, words, first, size = cutter(pieces), TaskContext.get().partitionId() << 32, 0, [], [], {}, [], 0

        def send() -> pa.RecordBatch:
            c = Chunk(cut, words, first)
            row = [base + n, rows, sums, c.lengths.astype(np.uint32).tobytes(), pack(c.flat), c.units]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                found = cut.words(t or "")
                rows.append(i)
                sums.append(None if t is None else np.uint64(xxhash.xxh64_intdigest(t.encode())).astype(np.int64).item())
                first.append(np.fromiter(map(words.setdefault, found, count(size)), np.uint32, len(found)))
                size += len(found)
                if size + len(rows) >= CHUNK_WORDS:
                    yield send()
                    n, rows, sums, words, first, size = n + 1, [], [], {}, [], 0
        if rows:
            yield send()

    return run


def _id_kind(pieces: Pieces) -> np.dtype:
    return np.dtype(">u2" if len(pieces.decoded) <= 65536 else ">u4")


def _gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + sizes[k]] for all k, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


PACKED = "of long, places binary, sizes binary, ids binary"


def _packed(pieces: Pieces):
    """(of, place, ids) -> for each chunk one row of many of its units' ids, so that they travel small."""
    kind = _id_kind(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            of, place, sizes, raw = (np.concatenate(x) for x in zip(*held, strict=True))
            values = raw.view(kind)
            order = np.lexsort((place, of))
            starts = (np.cumsum(sizes) - sizes)[order]
            of, place, sizes = of[order], place[order], sizes[order]
            edges = np.append(np.flatnonzero(np.diff(of, prepend=of[0] - 1)), len(of))
            rows = []
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                ids = _gather(starts[a:b], sizes[a:b], values).astype(np.uint32)
                rows.append((of[a].item(), pack(np.diff(place[a:b], prepend=0)), pack(sizes[a:b]), pack(ids)))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(2)
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + b.num_rows + 1].astype(np.int64)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), np.diff(at) // kind.itemsize, np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]]))
            n += b.num_rows
            if n >= PACK_UNITS:
                yield send()
                held, n = [], 0
        if n:
            yield send()

    return run


def _blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about BLOCK units; a longer one is a run of its own."""
    x = 0
    while x < len(ends) - 1:
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + BLOCK, side="right")) - 1)
        yield x, y
        x = y


def _finish(pieces: Pieces):
    """(chunk, its units' ids) -> a row a document."""
    letters = np.frombuffer(b"".join(pieces.decoded), np.uint8)
    width = np.array([len(p) for p in pieces.decoded])
    first = np.cumsum(width) - width

    def run(key: tuple, t: pa.Table, table: pa.Table) -> pa.Table:
        flat, lengths = unpack(t.column("flat")[0].as_py()), np.frombuffer(t.column("lengths")[0].as_py(), np.uint32).astype(np.int64)
        none = [np.zeros(0, np.int64)]
        get = lambda name: [unpack(x.as_py()).astype(np.int64) for x in table.column(name)]
        place, sizes = np.concatenate([np.cumsum(x) for x in get("places")] or none), np.concatenate(get("sizes") or none)
        values = np.concatenate([x.astype(np.uint32) for x in get("ids")] or none)
        order = np.argsort(place)
        if len(order) != (int(flat.max()) + 1 if len(flat) else 0):
            raise RuntimeError("a unit has no encoding")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        doc_ids, sums = t.column("doc_ids")[0].as_py(), t.column("sums")[0].as_py()

        def block(x: int, y: int) -> pa.RecordBatch:
            """Documents x to y."""
            here = flat[ends[x] : ends[y]]
            ids = _gather(starts[here], sizes[here], values)
            offsets = np.concatenate(([0], np.cumsum(sizes[here])))[ends[x : y + 1] - ends[x]]
            letters_at = np.concatenate(([0], np.cumsum(width[ids])))[offsets].tolist()
            raw = _gather(first[ids], width[ids], letters).tobytes()
            held = sums[x:y]
            intact = [None if s is None else np.uint64(xxhash.xxh64_intdigest(raw[a + (b > a) : b])).astype(np.int64).item() == s for a, b, s in zip(letters_at, letters_at[1:], held, strict=False)]
            out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([s is None for s in held]))
            counts = [None if s is None else n for n, s in zip(np.diff(offsets).tolist(), held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids[x:y], pa.int64()), pa.array(counts, pa.int64()), out, pa.array(intact, pa.bool_())], ["doc_id", "n_tokens", "ids", "intact"])

        return pa.Table.from_batches([block(a, b) for a, b in _blocks(ends)])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, merges: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, intact), one row a row of docs; intact: the ids decode to the text.

    merges: ids by the merges of a BPE model instead of the path of the best sum of scores.
    """
    pieces = load(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK_BYTES))
    with setting(spark, *BATCH):
        chunks = Buckets(rows.mapInArrow(_chunks(pieces), CHUNKS), "chunk", buckets, "pieces-chunks")
    named = chunks.read().select("chunk", F.posexplode("units").alias("place", "unit"))
    # dealt by the unit once, for the distinct ones and their edges; more units make more tasks
    n = chunks.read().agg(F.sum(F.size("units"))).first()[0] or 0
    units = named.select("unit").repartition(max(1, -(-n // TASK_UNITS)), "unit").distinct()
    # an id takes two bytes, or four of a large vocabulary
    digits = 2 * _id_kind(pieces).itemsize
    spelled = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), digits, "0")), ""))
    table = Scratch(encode_units(units, pieces, merges).select("unit", spelled.alias("ids")), "pieces-units").read()
    # a unit is one row of the table, so a frequent one may be split over tasks
    told = named.join(table, "unit").select(F.col("chunk").alias("of"), "place", "ids").mapInArrow(_packed(pieces), PACKED)
    return chunks.read().drop("units").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_finish(pieces), OUT)


def decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of its ids as text_col; unknown and control ids give nothing, null ids null."""
    from pyspark.sql.pandas.functions import pandas_udf

    pieces = load(model)

    @pandas_udf("string")
    def text(ids):
        import pandas as pd

        def one(x):
            if x is None:
                return None
            return b"".join(pieces.decoded[i] for i in x if 0 <= i < len(pieces.decoded)).decode("utf-8", "replace").removeprefix(" ")

        return pd.Series([one(x) for x in ids], dtype=object)

    return df.withColumn(text_col, text(F.col(ids_col)))
