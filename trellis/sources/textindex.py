"""A full-text index on disk: postings by term in blocks, with what bounds a block's scores.

A segment holds the postings of some documents. Documents of like length share blocks of about
BLOCK documents, the same blocks for all terms; a row of `postings` is a block of one term: its
documents with their lengths and the term's spots, their number, the highest frequency and the
least length. A file holds some blocks of all terms, in order of (term, block), so a search reads
the row groups of its own terms only, in each file. For an expression of plain words it reads the bounds first, which are small
columns: the best blocks set a threshold, and of the others only those are read whose bound
reaches it. The result is that of weighing all rows.

An update writes a segment of the new texts and names the documents of older segments that it
replaces or deletes; a list of segments, written last, makes it visible as a whole.

Defined cases: a row without words counts as a document; a null id is refused; of rows with
equal ids in one update one holds (the greatest by all columns); an empty table is an empty segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators.fulltext import PART_BITS, Node, counted, idf, judge, parse, phrases_of, plain_words, weight, words_in
from ..operators.search import scored
from .versions import create_next, materialize, read_last

BLOCK, FIRST_BLOCKS, ROW_GROUP = 128, 16, 4 << 20
LENGTH_STEPS = 4
POSTINGS = "term string, block long, n long, max_tf int, min_len int, docs array<struct<id: long, length: int, spots: array<bigint>>>"
DOCS = "id long, length int"
DEAD = "id long, segment string, length int"
#: More blocks than this are joined, not named in a filter.
NAMED_BLOCKS = 1000
#: Documents whose words a task sorts at once, beyond those of one block.
DOCS_AT_ONCE = 1000


class TextIndex:
    """The segments that a list names, as of when it was read; it never changes."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...], segments: list[str]):
        self.spark, self.root, self.columns, self.segments = spark, root, columns, segments

    # --- writing ---

    @classmethod
    def build(cls, df: DataFrame, id_col: str, columns: tuple[str, ...], root: str) -> TextIndex:
        """A new index of df under root."""
        return cls(df.sparkSession, root, columns, []).update(df, id_col)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> TextIndex:
        lines = read_last(spark, f"{root}/lists").splitlines()
        return cls(spark, root, tuple(lines[0].split(",")), lines[1:])

    def update(self, fresh: DataFrame, id_col: str = "id", gone: DataFrame | None = None) -> TextIndex:
        """The index with the rows of fresh in place of those of equal ids, and without the ids of gone (column id); an id in both stays."""
        if any("," in c or "\n" in c for c in self.columns):
            raise ValueError("a column's name has no comma and no line end")
        segment = uuid.uuid4().hex
        rows = fresh.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(self.columns)])
        if self.segments or gone is not None:
            rows = rows.groupBy("id").agg(F.max(F.struct(*[f"c{k}" for k in range(len(self.columns))])).alias("r")).select("id", "r.*")
        self._write(rows, segment)
        out = self._docs([segment]).select("id")
        if gone is not None:
            out = out.unionByName(gone.select(F.col("id").cast("long").alias("id")))
        live = self._live_docs().join(out.distinct(), "id", "left_semi") if self.segments else self.spark.createDataFrame([], DEAD)
        live.select("id", "segment", "length").write.parquet(f"{self.root}/dead/segment={segment}")
        create_next(self.spark, f"{self.root}/lists", "\n".join([",".join(self.columns), *self.segments, segment]))
        return TextIndex(self.spark, self.root, self.columns, [*self.segments, segment])

    def _write(self, rows: DataFrame, segment: str) -> None:
        names = [f"t{k}" for k in range(len(self.columns))]
        cut = rows.select(F.coalesce("id", F.raise_error(F.lit("a document has an id")).cast("long")).alias("id"), *[tokens(f"c{k}").alias(t) for k, t in enumerate(names)])
        # written, as texts are cut into words once for three readings
        sized = materialize(cut.select("*", sum((F.size(t) for t in names), F.lit(0)).alias("length")))
        sized.select("id", "length").write.parquet(f"{self.root}/docs/segment={segment}")
        # one number of blocks for each step of lengths: at most a hundred or so, whatever the corpus
        step = F.floor(F.log2(F.col("length") + 1) * LENGTH_STEPS).cast("int")
        per_step = {r.step: -(-r["count"] // _block_size(r.step)) for r in self._docs([segment]).groupBy(step.alias("step")).count().collect()}
        blocks = F.array(*[F.lit(per_step.get(k, 1)).cast("long") for k in range(max(per_step, default=0) + 1)])
        block = F.shiftleft(step.cast("long"), 40).bitwiseOR(F.pmod(F.xxhash64("id"), F.element_at(blocks, step + 1)))
        # documents are dealt by block, so that a task makes whole rows of it and only texts are shuffled; a file holds some blocks of all terms, in order
        dealt = sized.select("id", "length", block.alias("block"), *names).repartition("block").sortWithinPartitions("block", "id", "length")
        rows = dealt.mapInArrow(_postings(len(names)), POSTINGS).sortWithinPartitions("term", "block")
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/postings/segment={segment}")

    # --- reading ---

    def _read(self, table: str, schema: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        one = lambda s: self.spark.read.schema(schema).parquet(f"{self.root}/{table}/segment={s}").withColumn("segment", F.lit(s))
        return reduce(DataFrame.unionByName, [one(s) for s in segments])

    def _docs(self, segments: list[str]) -> DataFrame:
        return self._read("docs", DOCS, segments)

    def _dead(self) -> DataFrame:
        """Documents of segments that a later one replaces or deletes; the first segment has none."""
        paths = [f"{self.root}/dead/segment={s}" for s in self.segments[1:]]
        return self.spark.read.schema(DEAD).parquet(*paths) if paths else self.spark.createDataFrame([], DEAD)

    def _live_docs(self) -> DataFrame:
        return self._docs(self.segments).join(self._dead().select("id", "segment"), ["id", "segment"], "left_anti")

    def postings(self, words: list[tuple[str, bool]]) -> DataFrame:
        """Blocks of these words (word, whether a prefix), their terms pushed down to the files."""
        asked = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in words]
        return self._read("postings", POSTINGS, self.segments).filter(reduce(Column.__or__, asked))

    def _counted(self, blocks: DataFrame, tree: Node) -> DataFrame:
        """(id, length, own0, near0, ...) of the documents in blocks of postings."""
        rows = blocks.select("segment", "block", "term", F.explode("docs").alias("d")).select("segment", "term", "d.*")
        if len(self.segments) > 1:
            rows = rows.join(self._dead().select("id", "segment"), ["id", "segment"], "left_anti")
        words = words_in(tree)
        hit = lambda w: F.col("term").startswith(w[0]) if w[1] else F.col("term") == w[0]
        held = rows.groupBy("id", "length").agg(*[F.sort_array(F.flatten(F.collect_list(F.when(hit(w), F.col("spots"))))).alias(f"w{k}") for k, w in enumerate(words)])
        return counted(held, tree)

    def _size(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        sums = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("s")).first() for df in (self._docs(self.segments), self._dead())]
        n = sums[0].n - sums[1].n
        return n, (sums[0].s - sums[1].s) / n if n else 0.0

    def matches(self, query: str) -> DataFrame:
        """(id, score) of all rows that match an expression, as `bm25` gives them; all blocks of its terms are read."""
        tree = parse(query, self.columns)
        return self.spark.createDataFrame([], "id long, score double") if tree is None else self._all(tree, *self._size())

    def _all(self, tree: Node, n: int, mean: float) -> DataFrame:
        rows = materialize(self._counted(self.postings(words_in(tree)), tree))
        dfs = list(rows.agg(*[F.count_if(F.col(f"own{k}") > 0).alias(f"df{k}") for k in range(len(phrases_of(tree)))]).first())
        return self._weighed(rows, tree, n, mean, dfs)

    def search(self, query: str, top: int) -> DataFrame:
        """(id, score) of the best rows, as `match_terms` gives them."""
        tree = parse(query, self.columns)
        if tree is None or top <= 0:
            return self.spark.createDataFrame([], "id long, score double")
        n, mean = self._size()
        if plain_words(tree):
            dfs = self._frequencies(tree)
            blocks, self.read = self._promising(tree, self.postings(words_in(tree)), n, mean, dfs, top)
            found = self._weighed(self._counted(blocks, tree), tree, n, mean, dfs)
        else:
            found = self._all(tree, n, mean)
        return found.orderBy(F.desc("score"), "id").limit(top)

    def _weighed(self, rows: DataFrame, tree: Node, n: int, mean: float, dfs: list[int]) -> DataFrame:
        return scored(rows, tree, F.lit(n), F.lit(float(mean)), [F.lit(d) for d in dfs])

    def _frequencies(self, tree: Node) -> list[int]:
        """In how many documents each plain word stands: from the blocks' numbers, or, where documents are dead, from their ids."""
        words = [p.words[0] for p in phrases_of(tree)]
        blocks = self.postings(words)
        if len(self.segments) > 1:
            ids = blocks.select("term", "segment", F.explode("docs.id").alias("id")).join(self._dead().select("id", "segment"), ["id", "segment"], "left_anti")
            rows = ids.groupBy("term").agg(F.count("*").alias("df"))
        else:
            rows = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        df = {r.term: r.df for r in rows.collect()}
        return [df.get(w, 0) for w, _ in words]

    def _promising(self, tree: Node, blocks: DataFrame, n: int, mean: float, dfs: list[int], top: int) -> tuple[DataFrame, tuple[int, int]]:
        """The blocks whose bound reaches the top-th score of the best few, and how many of all those are."""
        words = [p.words[0][0] for p in phrases_of(tree)]
        bound = weight(F.lit(1.0), F.col("max_tf"), F.col("min_len"), F.lit(float(mean)))
        most = blocks.groupBy("segment", "block").agg(*[F.max(F.when(F.col("term") == w, bound)).alias(f"b{k}") for k, w in enumerate(words)])
        present = [F.col(f"b{k}").isNotNull() for k in range(len(words))]
        weights = [idf(F.lit(n), F.lit(d)) * F.coalesce(F.col(f"b{k}"), F.lit(0.0)) for k, d in enumerate(dfs)]
        bounds = materialize(most.select("segment", "block", *_bound(tree, present, weights)).filter("may").drop("may"))
        first = [tuple(r) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(max(FIRST_BLOCKS, -(-top // 8))).select("segment", "block").collect()]
        best = self._weighed(self._counted(_only(blocks, first), tree), tree, n, mean, dfs).orderBy(F.desc("score")).limit(top).collect()
        least = best[-1].score if len(best) == top else 0.0
        good = bounds.filter(F.col("bound") * (1 + 1e-9) >= least)
        of = bounds.agg(F.count("*").alias("all"), F.count_if(F.col("bound") * (1 + 1e-9) >= least).alias("good")).first()
        if of.good <= NAMED_BLOCKS:
            return _only(blocks, [tuple(r) for r in good.select("segment", "block").collect()]), (of.good, of["all"])
        return blocks.join(good.select("segment", "block"), ["segment", "block"], "left_semi"), (of.good, of["all"])


def _block_size(step: int) -> int:
    """Documents of a block; fewer of those beyond 32,000 words, so that a block's words stay within 4 million or one document."""
    return max(1, BLOCK >> max(0, step // LENGTH_STEPS - 14))


def _postings(columns: int):
    """Documents (id, length, block, t0, ...) in order of (block, id) to rows of POSTINGS; the last block of a batch waits for the next one.

    What it calls is inside, so that workers needn't import this module.
    """

    def whole(docs: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of POSTINGS of whole blocks."""
        doc, spot, word = [], [], []
        for k in range(columns):
            lists = docs.column(f"t{k}")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            doc.append(np.repeat(np.arange(len(n)), n))
            spot.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (k << PART_BITS))
            word.append(lists.flatten())
        doc, spot, words = np.concatenate(doc), np.concatenate(spot), pa.concat_arrays(word).dictionary_encode()
        block = docs.column("block").to_numpy()
        nth = np.cumsum(np.diff(block, prepend=block[:1]) != 0)
        code = words.indices.to_numpy().astype(np.int64)
        key = nth[doc] * len(words.dictionary) + code
        # stable sorts: by (block, term), then document, then spot
        by = np.argsort(doc, kind="stable")
        by = by[np.argsort(key[by], kind="stable")]
        key, doc = key[by], doc[by]
        held = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        spots = pa.ListArray.from_arrays(pa.array(np.append(held, len(by)).astype(np.int32)), pa.array(spot[by]))
        tf, of = np.diff(np.append(held, len(by))), doc[held]
        length = docs.column("length").take(pa.array(of))
        entries = pa.StructArray.from_arrays([docs.column("id").take(pa.array(of)), length, spots], ["id", "length", "spots"])
        first = np.flatnonzero(np.diff(key[held], prepend=-1))
        ends, at = np.append(first, len(held)).astype(np.int32), held[first]
        most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length.to_numpy(), first)) if len(first) else (tf, tf)
        return pa.RecordBatch.from_arrays([
            words.dictionary.take(pa.array(code[by][at])), pa.array(block[doc[at]]), pa.array(np.diff(ends).astype(np.int64)),
            pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), entries),
        ], ["term", "block", "n", "max_tf", "min_len", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in chain(batches, [None]):
            parts = [b for b in (kept, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            docs = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
            starts = np.append(0, np.flatnonzero(np.diff(docs.column("block").to_numpy())) + 1)
            if batch is None:
                starts = np.append(starts, docs.num_rows)
            else:
                # a copy, so that a waiting block doesn't hold its whole batch
                kept = docs.take(pa.array(np.arange(starts[-1], docs.num_rows)))
            at = 0
            while at < len(starts) - 1:
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + DOCS_AT_ONCE, "right")) - 1)
                yield whole(docs.slice(starts[at], starts[end] - starts[at]))
                at = end

    return run


def _only(blocks: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """Blocks of these (segment, block), named in a filter that reaches the files."""
    by: dict[str, list[int]] = {}
    for s, b in names:
        by.setdefault(s, []).append(b)
    return blocks.filter(reduce(Column.__or__, [(F.col("segment") == s) & F.col("block").isin(*b) for s, b in by.items()], F.lit(False)))


def _bound(tree: Node, present: list[Column], weights: list[Column]) -> tuple[Column, Column]:
    """(may, bound): whether a block may hold a match, and the most that one scores. What NOT excludes can't rule a block out."""
    free = _without_not(tree)
    keep = _kept(tree)
    may, bound = judge(free, [present[k] for k in keep], [weights[k] for k in keep])
    return may.alias("may"), bound.alias("bound")


def _without_not(tree: Node) -> Node:
    return _without_not(tree.children[0]) if tree.kind == "not" else Node(tree.kind, [_without_not(c) for c in tree.children], tree.phrases, tree.distance)


def _kept(tree: Node, at: int = 0) -> list[int]:
    """Numbers of the phrases that `_without_not` leaves."""
    if tree.phrases:
        return list(range(at, at + len(tree.phrases)))
    out = []
    for k, c in enumerate(tree.children):
        out += _kept(c, at) if tree.kind != "not" or k == 0 else []
        at += len(phrases_of(c))
    return out
