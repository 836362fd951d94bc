"""Line dedup by an exact set-similarity join (operator 4), in DataFrame functions only.

A line is the set of its words. Lines with equal sets are one class, whose first line
stays. Classes are joined on the rarest words of their sets: in order of rarity, two sets
whose Jaccard similarity reaches the threshold share a word of their prefixes. Length and
position in the prefix bound the overlap from above, and so do parities of the words
(every difference of parity is a word that only one set has). What passes is verified on
the whole sets, and a class goes if an earlier one is similar.

Both joins are semi joins: they end at the first partner, so a group of near copies costs
no pairs. An earlier line counts even if it goes itself, so the result doesn't depend on
the order of work. Words compare by 55 bits of their XXH64.

Defined cases: blank lines stay; a null text stays null; a text may become empty. Lines
are in order of (id, null last, then a hash of the text, then place); rows that repeat in
id and text count as one and lose the same lines.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, steps

OTHER_SPACE = "\t\x0b\x0c\r"
BUCKETS = 1 << 16
THRESHOLD = Fraction(4, 5)
#: The first join runs in as many slices of the words, one after the other: only one slice's shuffle is on disk.
SLICES = 4
#: Bits of the filter of texts that are read again: at most 8 MB, whatever the input.
FILTER = 1 << 26
PARITIES = ["parity0", "parity1", "parity2", "parity3"]


def even_spaces(text: Column) -> Column:
    """text with other white space than line ends as spaces; the search for it is cheaper than a pattern."""
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in OTHER_SPACE])
    return F.when(odd, F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(text)


def bucket_levels(texts: DataFrame) -> list[int]:
    """For each of BUCKETS hash buckets of words how frequent its words are, on a scale of logarithms.

    It counts every word of every text (column text); what comes to the driver has BUCKETS rows at most.
    """
    words = texts.select(F.explode(F.split(F.replace(even_spaces(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).groupBy("b").count()
    levels = [0] * BUCKETS
    for r in counts.select("b", F.floor(F.log2("count") * 6).cast("int").alias("level")).collect():
        levels[r.b] = r.level
    return levels


def set_of(line: Column, levels: list[int]) -> Column:
    """Distinct words of a line as sorted longs, the rarest first: a level of frequency, then 55 bits of the hash."""
    table = F.split(F.lit(",".join(str(x << 55) for x in levels)), ",").cast("array<bigint>")
    level = lambda h: F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    words = F.array_remove(F.split(line, " "), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: level(F.xxhash64(w)).bitwiseOR(F.xxhash64(w).bitwiseAND(F.lit((1 << 55) - 1))))))


def _parity(mask: int = 0, part: int = 0) -> Column:
    """Bit b: whether b stands in six bits of the hashes of an odd number of words; only of those with part in the bits of mask."""
    bit = "shiftleft(1L, int(shiftright(h, 49)))"  # a shift takes the last six bits of its distance
    return F.expr(f"aggregate(words, 0L, (s, h) -> s ^ {f'if((shiftright(h, 43) & {mask}) = {part}, {bit}, 0L)' if mask else bit})")


def measured(sets: DataFrame, t: Fraction) -> DataFrame:
    """sets (words) with n, their prefixes for t, and parities: 64 of them, 128 above 64 words, 256 above 200."""
    n = F.size("words")
    kept = (n - F.ceil(n * t.numerator / t.denominator) + 1).cast("int")
    none = F.lit(0).cast("long")
    parities = [
        F.when(n > 200, _parity(3, 0)).when(n > 64, _parity(1, 0)).otherwise(_parity()),
        F.when(n > 200, _parity(3, 1)).when(n > 64, _parity(1, 1)).otherwise(none),
        F.when(n > 200, _parity(3, 2)).otherwise(none),
        F.when(n > 200, _parity(3, 3)).otherwise(none),
    ]
    return sets.select("*", n.alias("n"), F.slice("words", F.lit(1), kept).alias("prefix"), *[c.alias(p) for c, p in zip(parities, PARITIES, strict=True)])


def _need(na: Column, nb: Column, t: Fraction) -> Column:
    """Smallest overlap of sets of na and nb words with a Jaccard similarity of t."""
    whole = t.numerator + t.denominator
    return F.floor(((na + nb) * t.numerator + whole - 1) / whole)


def _fits(a: str, b: str, t: Fraction) -> Column:
    """Length, position and parity filters for postings a and b of one word."""
    c = lambda side, name: F.col(f"{side}.{name}")
    na, nb = c(a, "n"), c(b, "n")
    need = _need(na, nb, t)
    apart = na + nb - need * 2  # words that only one of them may have
    xor = lambda *ps: reduce(Column.bitwiseXOR, (c(side, p) for side in (a, b) for p in ps))
    bits = lambda *groups: sum((F.bit_count(xor(*g)) for g in groups), F.lit(0))
    p0, p1, p2, p3 = PARITIES
    less = F.least(na, nb)
    return (
        (na * t.denominator >= nb * t.numerator)
        & (nb * t.denominator >= na * t.numerator)
        & (F.least(na - c(a, "i"), nb - c(b, "i")) >= need)
        & (bits(PARITIES) <= apart)
        & ((less <= 64) | (bits((p0, p2), (p1, p3)) <= apart))
        & ((less <= 200) | (bits((p0,), (p1,), (p2,), (p3,)) <= apart))
    )


def _postings(classes: DataFrame, t: Fraction, part: int) -> DataFrame:
    """One row a word of each prefix, of one slice; sets too small for a partner but themselves have none."""
    rows = classes.filter(F.col("n") > F.lit(t.numerator / (t.denominator - t.numerator)) - 1).select("*", F.posexplode("prefix").alias("i", "word")).drop("prefix")
    return rows.filter(F.col("word").bitwiseAND(F.lit(SLICES - 1)) == part)


def _sliced(find, label: str) -> DataFrame:
    """Distinct rows of find(slice) over all slices, each written before the next is worked on."""
    return reduce(DataFrame.unionByName, [Scratch(find(k).distinct(), label).read() for k in range(SLICES)]).distinct()


def _bit(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER)) + 1


def _only(rows: DataFrame, on: list[str], wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows that may be in wanted by its keys: all that are, and few others (as many as bits of the filter are set)."""
    set_bits = wanted.select(_bit(*keys).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    at = rows.withColumn("bit", _bit(*on)).withColumn("place", F.bitmap_bit_position("bit"))
    met = at.join(F.broadcast(set_bits), F.bitmap_bucket_number("bit") == F.col("bucket"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0).select(*rows.columns)


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """(id, text_hash, lost): for each text that loses lines their places, from 0."""
    t = Fraction(threshold)
    handle = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash")]
    rows = docs.filter(F.col(text_col).isNotNull())
    # hashed in a step before: beside the generator the text would travel with each line, to be hashed there
    cut = rows.select(*handle, F.split(even_spaces(F.col(text_col)), "\n").alias("lines"))
    lines = cut.select("id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    levels = bucket_levels(rows.select(F.col(text_col).alias("text")))
    # a filter on the sets themselves would be pushed below them and make them twice
    sets = lines.filter(F.trim("line") != "").select("id", "text_hash", "pos", set_of(F.col("line"), levels).alias("words"))
    key = [F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2")]
    wide = Scratch(measured(sets, t).select("id", "text_hash", "pos", *key, "n", "prefix", *PARITIES), "lines-sets")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"), F.col("pos"))
    # equal sets have equal values but for their places
    first = F.min(F.struct(order.alias("first"), "n", "prefix", *PARITIES)).alias("v")
    grouped = Scratch(wide.read().groupBy("k1", "k2").agg(first, F.count("*").alias("rows")).select("k1", "k2", "rows", "v.*"), "lines-classes")
    every = Scratch(wide.read().select("id", "text_hash", "pos", "k1", "k2"), "lines-keys").read()
    wide.drop()
    candidates = grouped.read().select("k1", "n", "prefix", *PARITIES)

    def partnered(part: int) -> DataFrame:
        p = _postings(candidates, t, part)
        return p.alias("a").join(p.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.k1") != F.col("b.k1")) & _fits("a", "b", t), "left_semi").select("k1", "i")

    # postings that fit another class's: what both classes of a similar pair have is among them, at the first word that their prefixes share
    maybe = Scratch(_sliced(partnered, "lines-maybe").groupBy("k1").agg(F.collect_list("i").alias("at")), "lines-maybe").read()
    classes = Scratch(grouped.read().select("k1", "k2", "rows", "first"), "lines-first").read()
    grouped.drop()

    # whole sets of the first lines of classes that may have a partner
    wanted = classes.join(maybe, "k1").select("k1", "k2", "first", "at", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), F.col("first.pos").alias("pos"))
    wanted = Scratch(wanted, "lines-wanted").read()
    places = wanted.groupBy(F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(F.collect_list(F.struct("pos", "k1", "k2", "first", "at")).alias("places"))
    texts = rows.select(*handle, F.col(text_col).alias("text"))
    if wanted.count() * 64 <= broadcast_bytes:
        places = F.broadcast(places)
    else:  # texts without a place stay where they are
        texts = _only(texts, ["id", "text_hash"], wanted, ["id", "text_hash"])
    texts = texts.withColumn("text", even_spaces(F.col("text"))).join(places, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    at = texts.withColumn("lines", F.split("text", "\n")).select("lines", F.explode("places").alias("p")).select("p.k1", "p.k2", "p.first", "p.at", set_of(F.element_at("lines", F.col("p.pos") + 1), levels).alias("words"))
    whole = Scratch(at.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.min("words").alias("words"), F.min("at").alias("at")), "lines-whole").read()
    full = Scratch(measured(whole, t).drop("prefix"), "lines-full").read()
    postings = full.select("*", F.explode("at").alias("i")).drop("at").withColumn("word", F.element_at("words", F.col("i") + 1))
    similar = F.size(F.array_intersect("a.words", "b.words")) >= _need(F.col("a.n"), F.col("b.n"), t)

    # an earlier class is another one; said so, both sides have the same columns and are shuffled once
    other = (F.col("a.k1") != F.col("b.k1")) | (F.col("a.k2") != F.col("b.k2"))
    fits = (F.col("a.word") == F.col("b.word")) & (F.col("b.first") < F.col("a.first")) & other & _fits("a", "b", t) & similar
    beaten = postings.alias("a").join(postings.alias("b").hint("merge"), fits, "left_semi").select("k1", "k2").distinct()
    gone = Scratch(beaten.withColumn("gone", F.lit(True)), "lines-gone").read()

    fate = classes.join(gone, ["k1", "k2"], "left").filter("gone or rows > 1").select("k1", "k2", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = every.select("id", "text_hash", "pos", "k1", "k2").join(fate, ["k1", "k2"]).filter(F.col("gone") | (order != F.col("first")))
    return judged.select("id", "text_hash", "pos").distinct().groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("lost"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, length_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """docs without the lines that an earlier line is similar to; rows and columns stay.

    length_col names a column that holds the number of characters, which is set anew;
    count_col a new one for the number of lines removed.
    """
    with steps():
        lost = Scratch(removed(docs, id_col=id_col, text_col=text_col, threshold=threshold), "lines-lost", result=True)
    lost = lost.read().select(F.col("id").alias("l_id"), F.col("text_hash").alias("l_hash"), "lost")
    # a row travels as one struct, so that no column of docs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    both = rows.join(lost, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")), "left")
    both = both.select("row", "lost", F.col("row").getField(text_col).alias("text"))
    both = both.withColumn("lines", F.when(F.col("lost").isNotNull(), F.split("text", "\n")))
    # places of the lines that stay: what array_except leaves, in order and by hashing; lines are named
    # twice, since what a lambda alone names is put into it and cut anew for each line that stays
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    new = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col("lines"), i + 1)), "\n"))
    both = both.select("row", "lost", new.alias("new"))
    out = [F.col("new").alias(c) if c == text_col else F.length("new").cast("long").alias(c) if c == length_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias(count_col))
    return both.select(*out)
