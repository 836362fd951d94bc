"""Tables on disk: intermediate ones, and published versions of an index."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CLUSTER, Index
from ..schemas import SCHEMA_VERSION, TABLES


def _root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints/trellis"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/trellis-{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts its lineage and survives lost executors."""
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a large shuffle sorts or groups.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks to deal rows to: as many as run at once, and more where a task would get more than TASK_ROWS."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the texts in a folder, ascending."""
    p, fs = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


#: The last line of a text that was written whole.
END = "\nend"


class Conflict(RuntimeError):
    """Another version was published since the one that this builds upon."""


def create_next(spark: SparkSession, folder: str, text: str, after: int | None = None) -> int:
    """Writes a text under the next number of a folder and gives the number; after: the number it builds upon.

    The file is made without overwriting, which a cluster's file system grants to one writer
    only: of two writers of one number the other is told. A text cut short has no last line and
    doesn't count; its number stays unused.
    """
    number = (max(_numbers(spark, folder), default=0) if after is None else after) + 1
    p, fs = _path(spark, f"{folder}/{number}")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict("another version was published at the same time; publish again") from e
        raise
    stream.write(bytearray((text + END).encode()))
    stream.close()
    return number


def _text(spark: SparkSession, folder: str, number: int) -> str | None:
    """The text of a number, None if it was cut short."""
    text = spark.read.text(f"{folder}/{number}", wholetext=True).first()
    return text[0].removesuffix(END) if text and text[0].endswith(END) else None


def read_last(spark: SparkSession, folder: str) -> str:
    """The whole text of the highest number in a folder."""
    for n in reversed(_numbers(spark, folder)):
        if (text := _text(spark, folder, n)) is not None:
            return text
    raise FileNotFoundError(folder)


#: Columns that deal a table's rows to buckets: those by which they change together. The others are small and have one bucket.
BUCKETED = {
    "symbols": ("project_id", "file_path"), "refs": ("in_project_id", "file_path"), "comments": ("project_id", "file_path"), "file_index": ("project_id", "file_path"),
    "call_graph": ("call_site_file",), "relationships": ("from_symbol_id",), "argument_flow": ("call_graph_id",), "return_flow": ("call_graph_id",), "snapshots": ("project_id", "git_commit"),
}


@dataclass
class Manifest:
    """What a version is made of: for each table and bucket its folder and a sum over its rows; batches: the last of each stream that it holds."""

    number: int = 0
    schema: int = SCHEMA_VERSION
    buckets: int = 64
    tables: dict[str, dict[str, list]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"schema": self.schema, "buckets": self.buckets, "tables": self.tables, "batches": self.batches})


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest | None:
    """The current version's manifest, or that of a number; None before the first."""
    numbers = _numbers(spark, f"{root}/current") if number is None else [number]
    for n in reversed(numbers):
        if (text := _text(spark, f"{root}/current", n)) is not None:
            found = Manifest(n, **json.loads(text))
            if found.schema > SCHEMA_VERSION:
                raise ValueError(f"the index has schema {found.schema}, this reads {SCHEMA_VERSION} at most")
            return found
    return None


def _sums(df: DataFrame) -> dict[str, list]:
    """{bucket: [rows, sum of hashes, xor of other hashes]}: equal for equal rows in any order."""
    columns = [c for c in df.columns if c != "bucket"]
    parts = [*columns, *[F.col(c).isNull() for c in columns]]
    sums = df.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *parts)).cast("string").alias("x"))
    return {str(r.bucket): [r.n, r.s, r.x] for r in sums.collect()}


def _write_changed(df: DataFrame, name: str, root: str, version: str, have: dict[str, list]) -> dict[str, list]:
    """Writes the buckets of a table that differ from those at hand; gives the new ones' manifest.

    A table is derived once: its first version is summed as it was written, a later one is
    written as it comes, summed, and its changed buckets are dealt from there.
    """
    spark, path, order = df.sparkSession, f"{root}/data/{version}/{name}", ["bucket", *CLUSTER.get(name, ())]

    def write(rows: DataFrame) -> None:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)

    if not have:
        write(df)
        sums = _sums(spark.read.schema(df.schema).parquet(path))
        return {b: [version, *s] for b, s in sums.items()}
    staged = scratch_folder(spark, "publish")
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    sums = _sums(rows)
    fresh = [b for b, s in sums.items() if b not in have or have[b][1:] != s]
    if fresh:
        write(rows.filter(F.col("bucket").isin(*map(int, fresh))))
    p, fs = _path(spark, staged)
    fs.delete(p, True)
    return {b: [version if b in fresh else have[b][0], *s] for b, s in sums.items()}


def publish(ix: Index, root: str, buckets: int = 64, batch: tuple[str, int] | None = None) -> int:
    """Makes ix the current version under root and gives its number; readers keep the version they began with.

    Rows are dealt to buckets, as many as the first version says. Only buckets whose rows differ
    from the current version's are written; the others stay the files they are. A manifest,
    written last under the next number, makes all of it current at once. batch: (stream, number)
    of the changes that ix holds, so that a stream that begins anew knows what it has done.
    """
    spark = ix.spark
    old = manifest(spark, root) or Manifest(buckets=buckets)
    version, tables = uuid.uuid4().hex, {}
    for name in TABLES:
        if getattr(ix.maker(name), "stored", None) == (root, old.tables.get(name, {})) and old.number:
            tables[name] = old.tables.get(name, {})  # as it was read
            continue
        keys = BUCKETED.get(name)
        df = ix[name].withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(old.buckets)).cast("int") if keys else F.lit(0))
        tables[name] = _write_changed(df, name, root, version, old.tables.get(name, {}))
    batches = old.batches | ({batch[0]: batch[1]} if batch else {})
    return create_next(spark, f"{root}/current", Manifest(0, SCHEMA_VERSION, old.buckets, tables, batches).text(), after=old.number)


class _Stored:
    """Reads a table of a version; knows what it is made of."""

    def __init__(self, spark: SparkSession, name: str, root: str, parts: dict[str, list]):
        self.spark, self.name, self.stored = spark, name, (root, parts)

    def __call__(self) -> DataFrame:
        root, parts = self.stored
        paths = [f"{root}/data/{s[0]}/{self.name}/bucket={b}" for b, s in parts.items()]
        return self.spark.read.schema(TABLES[self.name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[self.name])


def read_version(spark: SparkSession, root: str, m: Manifest) -> Index:
    """The index that a manifest names. Columns that an older schema lacks are null."""

    return Index(spark, {n: _Stored(spark, n, root, m.tables.get(n, {})) for n in TABLES})


def read_current(spark: SparkSession, root: str) -> Index:
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(root)
    return read_version(spark, root, m)


def collect_versions(spark: SparkSession, root: str, keep: int = 2, min_age_s: float = 86400) -> list[str]:
    """Removes all versions but the last few, and folders that none of those names; gives the folders removed.

    Folders younger than min_age_s stay: a version that is being written has no manifest yet.
    """
    numbers = _numbers(spark, f"{root}/current")
    kept = [m for n in numbers[-keep:] if _text(spark, f"{root}/current", n) is not None and (m := manifest(spark, root, n))]
    named = {f"{s[0]}/{t}/bucket={b}" for m in kept for t, all_ in m.tables.items() for b, s in all_.items()}
    for n in numbers[:-keep]:
        p, fs = _path(spark, f"{root}/current/{n}")
        fs.delete(p, False)
    top, fs = _path(spark, f"{root}/data")
    gone = []
    for v in fs.listStatus(top) if fs.exists(top) else []:
        if time.time() - v.getModificationTime() / 1000 < min_age_s:
            continue
        held = 0
        for t in fs.listStatus(v.getPath()):
            for b in [x for x in fs.listStatus(t.getPath()) if x.isDirectory()]:
                name = f"{v.getPath().getName()}/{t.getPath().getName()}/{b.getPath().getName()}"
                held += name in named
                if name not in named and fs.delete(b.getPath(), True):
                    gone.append(name)
        if not held:
            fs.delete(v.getPath(), True)
    return gone
