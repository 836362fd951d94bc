"""SimHash near-dedup over a Gray-order hierarchical index (operator 5).

Fingerprints are summed from XXH64 of word shingles. Two of them within 4 bits share one
of 5 segments, so each distinct fingerprint is dealt to the 5 groups of its segments. In a
group they are sorted by Gray rank and packed into nodes; a node holds the bits that all
below it share (a mask and a pattern). Pairs of nodes are descended together: the bits that
become shared on the way add to the differences of the pair, and a pair over the limit is
dropped with all below it. Found links leave as a spanning forest, not as pairs.

Operator 5's 4 bits link close copies only. keep_similar, for the pipeline, links texts by
similarity of at least 0.8 of their sets of five-word shingles instead: the index finds close
copies, an exact join on the rarest shingles finds all others, and both are verified on the
whole sets.

Defined cases: null and empty texts have the fingerprint 0; rows with equal ids are rows
of their own; a null id is never a component's id unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, steps

SHINGLE, SEED, LIMIT = 4, 42, 4
FAN, BLOCK, PIECE = 8, 4096, 1 << 14
#: Of keep_similar: words a shingle, the least Jaccard similarity as a fraction, and slices in which hashes are counted.
WORDS, ALIKE, SLICES = 5, (4, 5), 2


def shingles(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's runs of words; of all its words if they are fewer."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    runs = map(b" ".join, zip(*(words[k : k + n] for k in range(shingle)), strict=True)) if n > 0 else (b" ".join(words),)
    return np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64, max(n, 1))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return _bits(shingles(text, shingle, seed))


def _bits(h: np.ndarray) -> int:
    if not h.size:
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, h.size, 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > h.size, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place in the order in which neighbours differ by one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _levels(x: np.ndarray, seg: np.ndarray) -> list[tuple]:
    """Nodes from rows upwards until each segment has one: (mask, pattern, first child, end child, segment)."""
    full = np.full(len(x), ~np.uint64(0))
    levels = [(full, x, None, None, seg)]
    lo, hi = x, x
    while True:
        begin = np.searchsorted(seg, seg)
        turn = np.arange(len(seg)) - begin
        if not (turn > 0).any():
            return levels
        starts = np.flatnonzero(turn % FAN == 0)
        lo, hi = np.bitwise_and.reduceat(lo, starts), np.bitwise_or.reduceat(hi, starts)
        ends = np.append(starts[1:], len(seg))
        seg = seg[starts]
        levels.append((~(lo ^ hi), lo, starts, ends, seg))


def _pairs(levels: list[tuple], a: np.ndarray, b: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within limit below the given pairs of top nodes; a == b means all pairs within."""
    top = len(levels) - 1
    stack = [(top, a[k : k + PIECE], b[k : k + PIECE], None) for k in range(0, len(a), PIECE)]
    stack = [(lv, x, y, np.bitwise_count((levels[lv][1][x] ^ levels[lv][1][y]) & levels[lv][0][x] & levels[lv][0][y]).astype(np.int16)) for lv, x, y, _ in stack]
    while stack:
        lv, x, y, acc = stack.pop()
        near = acc <= limit
        x, y, acc = x[near], y[near], acc[near]
        if lv == 0:
            yield x, y
            continue
        _, _, first, end, _ = levels[lv]
        na, nb = end[x] - first[x], end[y] - first[y]
        n = na * nb
        total = int(n.sum())
        if total > 16 * PIECE and len(x) > 1:
            half = len(x) // 2
            stack += [(lv, x[:half], y[:half], acc[:half]), (lv, x[half:], y[half:], acc[half:])]
            continue
        parent = np.repeat(np.arange(len(x)), n)
        k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        cx, cy = first[x][parent] + k // nb[parent], first[y][parent] + k % nb[parent]
        same = x[parent] == y[parent]
        use = ~same | (cx < cy) if lv == 1 else ~same | (cx <= cy)
        parent, cx, cy = parent[use], cx[use], cy[use]
        mask, bits = levels[lv - 1][0], levels[lv - 1][1]
        px, py = x[parent], y[parent]
        fresh = mask[cx] & mask[cy] & ~(levels[lv][0][px] & levels[lv][0][py])
        stack.append((lv - 1, cx, cy, acc[parent] + np.bitwise_count((bits[cx] ^ bits[cy]) & fresh).astype(np.int16)))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the sets of all pairs joined; a label is the smallest index of its set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not (label[label] == label).all():
            label = label[label]


def forest(unit: np.ndarray, block: np.ndarray, x: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows and of the smallest row each is linked with, over all units given.

    Rows are sorted by unit, block and Gray rank. A unit of one block compares its rows with
    each other, a unit of two compares across.
    """
    key = np.empty(len(x), bool)
    key[0] = True
    key[1:] = (unit[1:] != unit[:-1]) | (block[1:] != block[:-1])
    seg = np.cumsum(key) - 1
    levels = _levels(x, seg)
    seg_unit = unit[key]
    twin = np.flatnonzero(seg_unit[1:] == seg_unit[:-1])
    alone = np.setdiff1d(np.arange(len(seg_unit)), np.concatenate((twin, twin + 1)))
    label = np.arange(len(x))
    for a, b in _pairs(levels, np.concatenate((alone, twin)), np.concatenate((alone, twin + 1)), limit):
        label = _join(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(x)))
    return linked, label[linked]


def _units(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(cols: tuple) -> pa.RecordBatch:
            unit, block, x, fp = cols
            a, b = forest(unit, block, x.view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            size += batch.num_rows
            if size < 1 << 15:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(-(cols[0] != cols[0][-1]).astype(np.int8), 0))  # where the last unit begins
            if cut:
                yield flush(tuple(c[:cut] for c in cols))
            held, size = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if size:
            yield flush(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def links(fps: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within limit bits.

    A group above block fingerprints is dealt by a hash to blocks, and every pair of its
    blocks is a unit of its own, so a unit never holds more than about two blocks. The list of
    such groups has at most (limit + 1) * 2**ceil(64 / (limit + 1)) rows.
    """
    parts = limit + 1
    widths = [64 // parts + (k < 64 % parts) for k in range(parts)]
    turns = np.cumsum([0, *widths[:-1]]).tolist()
    rotated = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k)) if k else F.col("fp")
    each = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), rotated(t).alias("x"), F.shiftrightunsigned(rotated(t), 64 - w).alias("key")) for i, (t, w) in enumerate(zip(turns, widths, strict=True))])).alias("s")).select("fp", "s.*")
    large = each.groupBy("part", "key").count().filter(F.col("count") > block).select(F.col("part").alias("p"), F.col("key").alias("k"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = Scratch(large, "simhash-groups").read()
    dealt = each.join(F.broadcast(large), (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    gray = F.col("x")
    for k in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, k)) if k == 1 else F.expr("g").bitwiseXOR(F.shiftrightunsigned(F.expr("g"), k))
        dealt = dealt.withColumn("g", gray)
    unit = F.xxhash64("part", "key", F.least("block", "other"), F.greatest("block", "other"))
    units = dealt.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(unit.alias("unit"), "block", "x", "fp", "g", "part", "key").repartition("unit").sortWithinPartitions("unit", "block", "g")
    return units.select("unit", "block", "x", "fp").mapInArrow(_units(limit), "a long, b long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(id, fp, component), one row a row of docs; component is the smallest id reachable."""
    rows = Scratch(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-rows").read()
    classes = Scratch(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes").read()
    member = Scratch(connected_components(links(classes, limit, block)), "simhash-members").read()
    of = classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("set"))
    named = of.join(of.groupBy("set").agg(F.min("least").alias("component")), "set").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with one row of each group: that of the smallest id, null last; columns stay.

    Of rows of one id in a group the one whose text has the smallest hash stays; rows that
    repeat in id and text count as one. Other columns may have any name.
    """
    key = [F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    # ids for the groups are rows' own: an id and a text
    rows = docs.select(key[0].alias("id"), key[1].alias("h"), F.col(text_col).alias("text"))
    made = Scratch(rows.mapInArrow(_keyed, "id long, h long, fp long"), "simhash-keyed").read()
    classes = made.groupBy("fp").agg(F.min("id").alias("least"))
    member = Scratch(connected_components(links(classes.select("fp"), limit)), "simhash-members").read()
    of = made.join(member, F.col("fp") == F.col("node"), "left").withColumn("set", F.coalesce("component", "fp"))
    best = of.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")).select(F.col("m.id").alias("b_id"), F.col("m.h").alias("b_h"))
    whole = docs.select(key[0].alias("id"), key[1].alias("h"), F.struct(*docs.columns).alias("row"))
    return whole.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), "left_semi").dropDuplicates(["id", "h"]).select("row.*")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f.view(np.int64))], ["id", "h", "fp"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _named(text: str | None) -> tuple[int, np.ndarray]:
    """A set's name, a hash of it, and its shingles' hashes in order."""
    h = np.unique(shingles(text, WORDS))
    return _signed(xxhash.xxh64_intdigest(h.tobytes())), h


ROWS = "id long, h long, name long, n long"
SETS = "name long, n long, fp long, hashes array<long>"


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(name, len(h)) for name, h in (_named(x.as_py()) for x in b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))], ["id", "h", "name", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows = [(name, len(h), _signed(_bits(h)), h.view(np.int64)) for name, h in (_named(x.as_py()) for x in b.column(0)[at : at + 256])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "n", "fp", "hashes"])


def _places(sets: DataFrame) -> DataFrame:
    """(g, i, name, n): the hashes of each set's prefix, at place i of the set in order of rarity.

    Rarity is the number of sets that hold a hash, then the hash. Hashes of one set alone come
    first and can't be shared, so only the others are counted out, and only what reaches into
    the prefix is given. Counting goes in slices of the hashes, one after the other.
    """
    num, den = ALIKE
    every = sets.select("name", "n", F.explode("hashes").alias("g"))
    parts = []
    for k in range(SLICES):
        part = every.filter(F.col("g").bitwiseAND(F.lit(SLICES - 1)) == k)
        counted = Scratch(part.groupBy("g").agg(F.count("*").alias("held")).filter("held > 1"), "simhash-held").read()
        parts.append(Scratch(part.join(counted, "g").select("name", "n", "held", "g"), "simhash-often").read())
    often = reduce(DataFrame.unionByName, parts)
    by_set = often.groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("held", "g"))).alias("order"))
    single = F.col("n") - F.size("order")
    reach = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - single
    taken = by_set.filter(reach > 0).select("name", "n", single.alias("single"), F.posexplode(F.slice("order", F.lit(1), reach.cast("int"))).alias("at", "o"))
    return taken.select(F.col("o.g").alias("g"), (F.col("single") + F.col("at")).alias("i"), "name", "n")


def similar(sets: DataFrame) -> DataFrame:
    """(node, component) of sets (name, n, fp, hashes; one row a set) that a chain of similar ones links.

    Close copies come from the Gray-order index over the sets' fingerprints. The rest is exact:
    two similar sets share a hash of both their prefixes in order of rarity, and the first such
    one stands early enough in both for the overlap they need. Holders of a hash that aren't
    joined yet are compared with its smallest holder, then, if still apart, with each other; so
    a group of near copies costs few pairs, and a frequent hash is in hardly any prefix.
    Every pair is verified on the whole sets.
    """
    num, den = ALIKE

    def verified(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of names whose sets are similar."""
        pairs = Scratch(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs").read()
        names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        whole = Scratch(sets.join(names, "name", "left_semi").select("name", "hashes"), "simhash-whole")
        side = lambda name, of: whole.read().select(F.col("name").alias(name), F.col("hashes").alias(of))
        met = F.size(F.array_intersect("x", "y"))
        alike = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(met * den >= (F.size("x") + F.size("y") - met) * num)
        found = Scratch(alike.select("a", "b"), "simhash-alike").read()
        whole.drop()
        return found

    prints = Scratch(sets.groupBy("fp").agg(F.min("name").alias("name")), "simhash-prints").read()
    named = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("name").alias(name))
    close = links(prints.select("fp")).select(F.col("a").alias("p"), F.col("b").alias("q")).join(named("p", "a"), "p").join(named("q", "b"), "q").select("a", "b")
    same = sets.select("fp", F.col("name").alias("a")).join(named("fp", "b"), "fp").select("a", "b")
    found = verified(close.unionByName(same))
    with steps():
        places = Scratch(_places(sets), "simhash-places", result=True)

    def placed(found: DataFrame) -> DataFrame:
        """Places with the set of those joined so far, of hashes whose holders aren't all in one."""
        joined = Scratch(connected_components(found), "simhash-joined").read()
        p = places.read().join(joined, F.col("name") == F.col("node"), "left").select("g", F.struct("name", "n", "i", F.coalesce("component", "name").alias("set")).alias("x"))
        apart = p.groupBy("g").agg((F.min("x.set") != F.max("x.set")).alias("apart")).filter("apart").select("g")
        return Scratch(p.join(apart, "g", "left_semi"), "simhash-open").read()

    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    fits = (F.col("x.set") != F.col("y.set")) & (F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) >= need) & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
    ends = [F.col("x.name").alias("a"), F.col("y.name").alias("b")]
    open_ = placed(found)
    least = open_.groupBy("g").agg(F.min("x").alias("y"))
    found = found.unionByName(verified(open_.join(least, "g").filter(fits).select(*ends)))
    open_ = placed(found)
    other = open_.select("g", F.col("x").alias("y"))
    return connected_components(found.unionByName(verified(open_.join(other, "g").filter(fits & (F.col("x.set") < F.col("y.set"))).select(*ends))))


def keep_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id, null last; columns stay.

    Texts are similar whose five-word shingles have a Jaccard similarity of at least 0.8;
    those without words are one group. Rows that repeat in id and text count as one; of rows
    of one id the one whose text has the smallest hash stays. Other columns may have any name.
    """
    key = [F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    handle = F.struct(F.col("id").isNull().alias("none"), "id", "h")

    def at(best: DataFrame) -> DataFrame:
        """The rows of docs with an id and a text of best (m), each once, as a row of its columns."""
        # the null-safe key in columns of its own, so that the join and the removal of repeats share one shuffle
        of = lambda i, h: (F.coalesce(i, F.lit(0)).alias("k"), i.isNull().alias("none"), h.alias("h"))
        wanted = best.select(*of(F.col("m.id"), F.col("m.h"))).distinct()
        return docs.select(*of(*key), F.struct(*docs.columns).alias("row")).join(wanted, ["k", "none", "h"], "left_semi").dropDuplicates(["k", "none", "h"])

    with steps():
        rows = Scratch(docs.select(key[0].alias("id"), key[1].alias("h"), F.col(text_col).alias("text")).mapInArrow(_names, ROWS), "simhash-rows").read()
        one = rows.filter("n > 0").groupBy("name").agg(F.min(handle).alias("m"))
        sets = at(one).select(F.col("row").getField(text_col).alias("text")).mapInArrow(_sets, SETS)
        with steps():
            member = Scratch(similar(Scratch(sets, "simhash-sets").read()), "simhash-members", result=True).read()
        of = rows.select("id", "h", "name").join(member, F.col("name") == F.col("node"), "left").withColumn("set", F.coalesce("component", "name"))
        best = Scratch(of.groupBy("set").agg(F.min(handle).alias("m")), "simhash-kept", result=True)
    return at(best.read()).select("row.*")
