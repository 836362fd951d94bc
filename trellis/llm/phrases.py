"""Phrase collocation mining over positional inverted lists (operator 11).

Each phrase of a chunk of text has the sorted list of the positions where it starts. Lists
are extended level by level: the occurrences of a frequent phrase are merge-joined with the
postings of the words next to it, which are the last words of the frequent phrases of the same
length that start one position later (no others can be part of a longer frequent phrase). The
length of the joined list, summed over all chunks, is the longer phrase's exact frequency.
A chunk's lists lie side by side in order of position, so one merge joins all of them.

Lists stay where they are: from level to level a chunk sends the lengths of its lists, dealt to
buckets by their left phrases; they are summed by phrase, some whole buckets at a time, and the
chunks are told which of their lists stay. A phrase's id is the place of its first list, so that no
join has to give it out; words are compared as such. There is a bucket for each BUCKET words of the
corpus, and a left phrase of more than SALT occurrences, whose number is known by then, is dealt
to several, so that what meets in one bucket is bounded.
Chunks are cut anywhere: four words more than a chunk's own are looked at but not counted.

Defined cases: a null text is empty, a null lang is `und`; texts that repeat count as often;
a text of any length is cut into chunks as it is read; an empty table or a language without
frequent phrases gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .hpyp import pack, unpack

CHUNK_WORDS, SLICE = 1_000_000, 1 << 20
#: Bits of a place for the number of a list in its chunk, and of a chunk for its number in its task.
LIST_BITS, TASK_BITS = 21, 16
#: Occurrences of a left phrase in one bucket at most, words of the corpus a bucket, list lengths summed at a time.
SALT, BUCKET, MERGED = 1 << 17, 1 << 19, 1 << 20
BREAK = b"."
#: Lower case for A-Z, a break for each separator, a space for a tab.
TABLE = bytes(c + 32 if 65 <= c <= 90 else BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
EDGE = re.compile(rb"[ .]")

CHUNK = "chunk long, lang string, own int, size int, at binary, keys binary, words array<string>, counts array<int>"
TOLD = "chunk long, ks binary, ids binary, fs binary, found array<long>, lefts array<long>, rests array<long>, sums array<long>"
LEVEL = "chunk long, lang string, own int, size int, at binary, keys binary, groups array<struct<bucket:long,first:int,lefts:binary,rests:binary,counts:binary>>"
STATE = ("chunk", "lang", "own", "size", "at", "keys")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """A text's words and breaks, in slices that end at a space or a break; it ends with a break."""
    start = 0
    while start < len(text):
        edge = EDGE.search(text, start + SLICE)
        end = edge.start() if edge else len(text)
        yield text[start:end].replace(BREAK, b" . ").split()
        start = end
    yield [BREAK]


def _postings(chunk: int, lang: str, held: list[bytes], own: int) -> tuple:
    """A chunk: where its words stand and which they are, its words and how often each stands in the chunk's own part."""
    names = defaultdict(count().__next__)
    names[BREAK]
    flat = np.fromiter(map(names.__getitem__, held), np.int64, len(held))
    at = np.flatnonzero(flat)
    keys = flat[at] - 1
    counts = np.bincount(keys[at < own], minlength=len(names) - 1)
    return chunk, lang, own, len(counts), pack(np.diff(at, prepend=0)), pack(keys), [w.decode() for w in names][1:], counts.tolist()


def _chunks(most: int, longest: int):
    """Texts, as bytes, cut into chunks by language; in all at most twice `most` words and a slice are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = count(TaskContext.get().partitionId() << TASK_BITS)
        open_: dict[str, list[bytes]] = defaultdict(list)
        held = 0
        row = lambda lang, words, own: _record(CHUNK, [_postings(next(ids), lang, words, own)])
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                words, lang = open_[lang.as_py()], lang.as_py()
                for part in tokens(text.as_py().translate(TABLE)):
                    words += part
                    held += len(part)
                    while len(words) >= most + longest - 1:
                        yield row(lang, words[: most + longest - 1], most)
                        del words[:most]
                        held -= most
                while held > 2 * most:  # many languages: the largest open chunk ends here, after a whole text
                    largest = max(open_, key=lambda x: len(open_[x]))
                    whole = open_.pop(largest)
                    held -= len(whole)
                    yield row(largest, whole, len(whole))
        for lang, words in open_.items():
            if words:
                yield row(lang, words, len(words))

    return run


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _mix(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def extend(at: np.ndarray, keys: np.ndarray, ids: np.ndarray, salts: np.ndarray, own: int, buckets: int) -> tuple:
    """Lists of all phrases one word longer: (at, keys, buckets, lefts, rests, counts), lists in order of bucket and left.

    at, keys: sorted starts of a chunk's phrases and which they are; ids: their ids, -1 for
    those that aren't frequent; salts: over how many buckets each is dealt as a left phrase. A merge
    joins each start with the next one, where the phrase without the first word must start; lefts
    and rests are the ids of the two.
    """
    live = ids[keys] >= 0
    at, keys = at[live], keys[live]
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    n = max(1, len(ids))
    pair, joined = np.unique(keys[here] * n + keys[here + 1], return_inverse=True)
    left, rest = pair // n, ids[pair % n]
    bucket = (_mix(ids[left]) + _mix(rest) % salts[left]) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, joined = at[here], place[joined]
    return at, joined, bucket[order], ids[left[order]], rest[order], np.bincount(joined[at < own], minlength=len(pair))


def _groups(bucket: np.ndarray, *lists: np.ndarray) -> list[tuple]:
    """The lists of a chunk, those of one bucket together."""
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    parts = zip(*[np.split(x, new[1:]) for x in lists], strict=True)
    return [(int(bucket[a]), int(a), *[pack(x, np.int64) for x in p]) for a, p in zip(new, parts, strict=True)]


GROUP = ("bucket", "first", "lefts", "rests", "counts")
GROUPS = pa.list_(pa.struct([*zip(GROUP, (pa.int64(), pa.int32(), *[pa.binary()] * 3))]))


def _extend(buckets: int):
    def run(key: tuple, state: pa.Table, told: pa.Table) -> pa.Table:
        return _extended(state, told, buckets)

    return run


def _extended(state: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    fixed = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("own", pa.int32()), ("size", pa.int32()), ("at", pa.binary()), ("keys", pa.binary())])
    if state.num_rows and told.num_rows:
        chunk, lang, own, size, gaps, keys = (state.column(n)[0].as_py() for n in STATE)
        ids, salts = np.full(size, -1, np.int64), np.ones(size, np.int64)
        for k, i, f in zip(*[told.column(n).to_pylist() for n in ("ks", "ids", "fs")], strict=True):
            k = unpack(k)
            ids[k], salts[k] = unpack(i, np.int64), unpack(f, np.int64) // SALT + 1
        at, joined, *lists = extend(np.cumsum(unpack(gaps), dtype=np.int64), unpack(keys).astype(np.int64), ids, salts, own, buckets)
        if len(at):
            row = [[chunk], [lang], [own], [len(lists[0])], [pack(np.diff(at, prepend=0))], [pack(joined)]]
            groups = [dict(zip(GROUP, g, strict=True)) for g in _groups(*lists)]
            return pa.Table.from_arrays([*[pa.array(c, t) for c, t in zip(row, fixed.types, strict=True)], pa.array([groups], GROUPS)], names=[*fixed.names, "groups"])
    return fixed.append(pa.field("groups", GROUPS)).empty_table()


def _deal(place: np.ndarray, ids: np.ndarray, fs: np.ndarray) -> Iterator[tuple]:
    """Rows (chunk, ks, ids, fs) that tell each chunk of its lists at these places."""
    order = np.argsort(place >> LIST_BITS, kind="stable")
    chunk = place[order] >> LIST_BITS
    for part in np.split(order, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1) if len(order) else []:
        yield int(place[part[0]] >> LIST_BITS), pack(place[part] & (1 << LIST_BITS) - 1), pack(ids[part], np.int64), pack(fs[part], np.int64)


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent words (id, f, places) as rows to the chunks."""
    for b in batches:
        sizes, place = b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()
        rows = list(_deal(place, *[np.repeat(b.column(k).to_numpy(), sizes) for k in (0, 1)]))
        yield _record(TOLD, [(*r, None, None, None, None) for r in rows])


def _summed(lists: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """lists: rows (left, rest, place, n), all of the phrases they are of; what chunks are told, and the frequent phrases."""
    left, rest, place, n = lists[:, np.lexsort((lists[1], lists[0]))]
    new = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (rest[1:] != rest[:-1]))))
    f, first = np.add.reduceat(n, new), np.minimum.reduceat(place, new)
    stay, sizes = f >= least, np.diff(np.append(new, len(left)))
    all_stay = np.repeat(stay, sizes)
    rows = [(*r, None, None, None, None) for r in _deal(place[all_stay], np.repeat(first, sizes)[all_stay], np.repeat(f, sizes)[all_stay])]
    if stay.any():
        rows.append((None, None, None, None, *[x[stay] for x in (first, left[new], rest[new], f)]))
        yield _record(TOLD, rows)


def _sum_lists(least: int, at_once: int):
    """Rows (bucket, chunk, first, lefts, rests, counts) in order of bucket, summed whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for bucket, chunk, first, *lists in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= at_once and bucket != last:
                    yield from _summed(np.concatenate(held, 1), least)
                    held, size = [], 0
                lefts, rests, counts = (unpack(x, np.int64) for x in lists)
                held.append(np.stack((lefts, rests, (chunk << LIST_BITS) + first + np.arange(len(lefts)), counts)))
                size, last = size + len(lefts), bucket
        if size:
            yield from _summed(np.concatenate(held, 1), least)

    return run


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, chunk_words: int = CHUNK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1 to longest words, and (lang, n) of all languages.

    A table has (id, lang, phrase, f, left, rest, firsts, lasts): left and rest are the ids,
    one table before, of the phrase without its last and its first word; firsts and lasts
    the frequencies of its first and last 1, 2, ... words, itself included.
    """
    if chunk_words + longest > 1 << LIST_BITS:
        raise ValueError(f"a chunk has fewer than {1 << LIST_BITS} words")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    now = Scratch(rows.mapInArrow(_chunks(chunk_words, longest), CHUNK), "phrases-1")
    sizes = Scratch(now.read().select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "phrases-n").read()
    words = now.read().select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "z"))
    words = words.select("lang", F.col("z.words").alias("phrase"), F.shiftleft("chunk", LIST_BITS).bitwiseOR(F.col("k").cast("long")).alias("place"), F.col("z.counts").cast("long").alias("n"))
    often = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.collect_list("place").alias("places")).filter(F.col("f") >= least)
    found = Scratch(often.select(F.array_min("places").alias("id"), "lang", "phrase", "f", "places"), "phrases-words").read()
    none = F.lit(None).cast("long")
    buckets = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    tables = [found.select("id", "lang", "phrase", "f", none.alias("left"), none.alias("rest"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))]
    told = found.select("id", "f", "places").mapInArrow(_tell, TOLD)
    for m in range(2, longest + 1):
        nxt = Scratch(now.read().select(*STATE).groupBy("chunk").cogroup(told.select("chunk", "ks", "ids", "fs").groupBy("chunk")).applyInArrow(_extend(buckets), LEVEL), f"phrases-{m}")
        now.drop()
        now = nxt
        lists = now.read().select("chunk", F.explode("groups").alias("g")).select("g.bucket", "chunk", "g.first", "g.lefts", "g.rests", "g.counts")
        summed = Scratch(lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sum_lists(least, MERGED), TOLD), "phrases-told").read()
        told = summed.filter("chunk IS NOT NULL")
        sums = summed.filter("chunk IS NULL").select(F.inline(F.arrays_zip("found", "lefts", "rests", "sums")))
        shorter = tables[-1]
        lefts = shorter.select(F.col("id").alias("lefts"), "lang", F.col("phrase").alias("l_phrase"), "firsts")
        rests = shorter.select(F.col("id").alias("rests"), F.substring_index("phrase", " ", -1).alias("word"), "lasts")
        longer = sums.join(lefts, "lefts").join(rests, "rests").select(
            F.col("found").alias("id"), "lang", F.concat_ws(" ", "l_phrase", "word").alias("phrase"), F.col("sums").alias("f"), F.col("lefts").alias("left"), F.col("rests").alias("rest"),
            F.concat("firsts", F.array("sums")).alias("firsts"), F.concat("lasts", F.array("sums")).alias("lasts"))
        tables.append(Scratch(longer, "phrases-found").read())
    now.drop()
    return tables, sizes


def _cuts(m: int) -> Column:
    """The lowest-scoring cut (score, k, l, r) of a phrase of m words, in decimals of 38 digits; a, n, firsts and lasts are columns."""
    cuts = []
    for k in range(1, m):
        top = "cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * cast(1000 as decimal(4,0))"
        score = F.expr(f"{top} div (cast(firsts[{k - 1}] as decimal(19,0)) * cast(lasts[{m - k - 1}] as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col("firsts")[k - 1].alias("l"), F.col("lasts")[m - k - 1].alias("r")))
    return cuts[0] if m == 2 else F.least(*cuts)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, salts: int = 64, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to longest words of each language.

    A phrase goes if one that holds it is at least share percent as frequent. It suffices to
    look one word further: a longer phrase is never more frequent than those between the two.
    The best are found first within salts of a language, so that no task ranks a whole one.
    """
    tables, sizes = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least, chunk_words=chunk_words)
    kept = []
    for m in range(2, longest + 1):
        t = tables[m - 1]
        if m < longest:
            held = tables[m].select(F.explode(F.array("left", "rest")).alias("inner"), F.col("f").alias("outer")).groupBy("inner").agg(F.max("outer").alias("outer"))
            t = t.join(held, F.col("id") == F.col("inner"), "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("f") * share))
        scored = t.join(sizes.withColumnRenamed("lang", "s_lang"), F.col("lang") == F.col("s_lang")).withColumn("a", F.col("f"))
        kept.append(scored.select("lang", "phrase", "a", "n", _cuts(m).alias("cut")))
    both = kept[0]
    for t in kept[1:]:
        both = both.unionByName(t)
    rows = both.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
