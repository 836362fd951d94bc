"""File changes as a stream, gathered into batches once a folder has been quiet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import is_ignored
from ..sources.versions import manifest, materialize, publish, read_version
from .incremental import apply_changes, cascade_items, signature_changes

CHANGES = "root string, path string, change string, ts timestamp"
#: Files whose changes count.
WATCHED = r"(?i)\.(?:cs|csproj)$"


def change_source(spark: SparkSession, path: str) -> DataFrame:
    """Changes as they arrive as Parquet files (CHANGES) under a path."""
    return spark.readStream.schema(CHANGES).parquet(path)


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """(root, start, end, paths): sessions of changes of a root with no pause of gap, each path once whatever its case.

    Each change restarts the pause, so a batch is a session window. For a stream, late is
    how late a change may come; the last session of a root leaves when the watermark passes it.
    """
    rows = changes.filter(F.col("path").rlike(WATCHED) & ~is_ignored("path"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    sessions = rows.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set(F.lower("path"))).alias("paths"))
    return sessions.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths")


def maintain(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "500 milliseconds", late: str = "10 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Runs handle on each micro-batch of debounced changes; its state is in the checkpoint folder, so it goes on after a restart."""
    writer = debounced(changes, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


#: (changed files of a batch) -> changes as `apply_changes` takes them, and the tables of rows of those files.
Extract = Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]]


def _extracted(extract: Extract, files: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    changes, fresh = extract(files)
    return materialize(changes), {n: materialize(t) for n, t in fresh.items()}


def index_batch(spark: SparkSession, root: str, sessions: DataFrame, number: int, extract: Extract, stream: str = "changes") -> int | None:
    """One batch of debounced changes into the index under root, as one new version; its number, or None if the index holds the batch or it is empty.

    Files that use symbols whose signature has changed are extracted in a second pass, over the
    first one's result; both are published together, with the batch's number. So a batch that
    is repeated after a failure, wherever it happened, changes nothing or everything.
    """
    # read whole even if the index holds the batch: else the stream's state isn't committed
    files = materialize(sessions.select(F.explode("paths").alias("file_path")).distinct())
    m = manifest(spark, root)
    if m is None or m.batches.get(stream, -1) >= number or files.isEmpty():
        return None
    ix = read_version(spark, root, m)
    changes, fresh = _extracted(extract, files)
    now = apply_changes(ix, changes, fresh)
    if "symbols" in fresh:
        users = cascade_items(ix, signature_changes(ix.symbols, fresh["symbols"])).select("file_path")
        again = materialize(users.join(files, "file_path", "left_anti").distinct())
        if not again.isEmpty():
            now = apply_changes(now, *_extracted(extract, again))
    return publish(now, root, batch=(stream, number))


def maintain_index(changes: DataFrame, root: str, extract: Extract, checkpoint: str, gap: str = "500 milliseconds", late: str = "10 seconds", stream: str = "changes", trigger: dict | None = None) -> StreamingQuery:
    """Watches changes, debounces them and keeps the index under root up to date; goes on after a restart where it was."""
    return maintain(changes, lambda df, n: index_batch(df.sparkSession, root, df, n, extract, stream) and None, checkpoint, gap, late, trigger)
