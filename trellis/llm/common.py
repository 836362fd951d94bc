"""What the operators of this subpackage share: input, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space, as in the contracts of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as an empty text."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.crc32(text) % folds


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir.

    Unset, only a local master gets a folder of its own; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints/trellis"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/trellis-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files go once the execution that wrote them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str, usual: str) -> Iterator[None]:
    """The session's setting while the body runs; usual: what holds if it has none."""
    before = spark.conf.get(key, usual)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tidy(spark: SparkSession):
    return setting(spark, CLEAN_UP, "true", "false")


#: Tables of the steps that are going on, the innermost last.
_GOING: ContextVar[tuple[list, ...]] = ContextVar("going", default=())


@contextmanager
def steps() -> Iterator[None]:
    """Tables written inside are dropped at its end, but for results: what is read later has to be one."""
    own: list = []
    token = _GOING.set((*_GOING.get(), own))
    try:
        yield
    finally:
        _GOING.reset(token)
        for t in own:
            t.drop()


def _enlist(t: Scratch | Buckets, result: bool) -> None:
    going = _GOING.get()[: -1 if result else None]
    if going:
        going[-1].append(t)


class Scratch:
    """A table written once and read again: it survives lost executors and cuts lineage.

    The shuffle files of its making are removed when it is written, as nothing reads them again.
    A result outlives the innermost steps.
    """

    def __init__(self, df: DataFrame, label: str, *, result: bool = False):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        _enlist(self, result)
        with _tidy(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


#: The setting, and its usual value, of the most buckets that a table may have.
MOST_BUCKETS = ("spark.sql.sources.bucketing.maxBuckets", "100000")


class Buckets:
    """A table written once, bucketed by a key, so that groups of the key need no shuffle of it.

    A bucket holds several values of the key where there are more than a table may have buckets.
    """

    def __init__(self, df: DataFrame, key: str, buckets: int, label: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        self.name = f"trellis_{uuid.uuid4().hex}"
        _enlist(self, False)
        buckets = min(buckets, int(self.spark.conf.get(*MOST_BUCKETS)))
        with _tidy(self.spark):
            df.write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(buckets, key).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node.

    Large-star and small-star in turn (Kiveris et al., 2014). Each half is a grouped
    minimum, which combines before the shuffle, and an equi-join that adaptive execution
    can split, so a node with very many edges meets in no single task's memory.
    Null ends, loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    start = edges.select(*pair(F.col(a), F.col(b))).filter("u <> v").distinct()
    now, mark = Scratch(start, "edges"), None
    for _ in range(max_rounds):
        e = now.read()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        mid = Scratch(large, "edges")
        e2 = mid.read()
        low2 = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").filter("u <> v").distinct()
        nxt = Scratch(small, "edges")
        now.drop()
        mid.drop()
        now = nxt
        sums = now.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    stars = now.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
