"""Deterministic sharded WARC archives (operator 7).

Records are dealt to shards by ranges of their page id, sorted within a shard, written as
one gzip member each into files that roll by compressed size, and committed through
temporary names and a manifest for each shard. The same rows give the same bytes,
whatever the number of tasks or of attempts.

Defined cases: a null payload is empty; a null id sorts first and reads back as null; a
null address leaves out its header; of equal payloads all rows with the largest id are
responses (more than one only if whole rows repeat) and the others revisit that id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, scratch_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUCKETS = 4096
FILES = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, intact boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{url}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str = DATE) -> bytes:
    """One response, or a revisit of keeper if that is another page."""
    digest, response = base32_sha1(payload), keeper is None or keeper == page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    clean = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, url)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    fields += [] if response else [("WARC-Profile", PROFILE), ("X-Refers-To-Page", keeper)]
    fields += [("X-Page", "" if page_id is None else page_id), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head(fields) + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """Writes one shard: rolls, then renames, then the manifest."""

    def __init__(self, root: str, shard: int, roll: int):
        from pyarrow import fs

        self.fs, self.dir = fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.shard, self.roll, self.tag, self.done = shard, roll, uuid.uuid4().hex, []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None or self.size + len(data) > self.roll and self.n:
            self.close()
            self.name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.tmp = f"{self.dir}/_tmp-{self.tag}-{self.name}"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
            info = b"software: trellis\r\nformat: WARC File Format 1.1\r\n"
            self._put(member(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, None)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"))
        self._put(data)
        self.n += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.tmp, self.name, self.n, self.size, self.sha.hexdigest()))
            self.out = None

    def commit(self) -> list[tuple]:
        self.close()
        for tmp, name, *_ in self.done:
            self.fs.move(tmp, f"{self.dir}/{name}")
        rows = [(self.shard, *d[1:]) for d in self.done]
        note = f"{self.dir}/_tmp-{self.tag}-manifest"
        with self.fs.open_output_stream(note) as f:
            f.write(json.dumps([dict(zip(("shard", "file", "records", "bytes", "sha256"), r, strict=True)) for r in rows], sort_keys=True).encode())
        self.fs.move(note, f"{self.dir}/manifest-{self.shard:06d}.json")
        return rows


def _writer(root: str, roll: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha256"])
        for b in batches:
            shards, ids, urls, texts, keepers = (b.column(i) for i in range(5))
            for i in range(b.num_rows):
                shard = shards[i].as_py()
                if now is None or now.shard != shard:
                    if now is not None:
                        yield send(now.commit())
                    now = _Files(root, shard, roll)
                payload = texts[i].as_py()
                now.add(member(record(ids[i].as_py(), urls[i].as_py(), (payload or "").encode(), keepers[i].as_py()), level))
        if now is not None:
            yield send(now.commit())

    return write


def write(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = 64 << 20, roll_bytes: int = 32 << 20, level: int = 6, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Writes the archives under root and returns their manifest (FILES).

    Shard borders come from a histogram of payload bytes over BUCKETS ranges of the id, so
    they don't depend on sampling; a range with more than its share (an id that repeats, say)
    is dealt on by the digest. Pages whose payload is shared learn the largest id from the
    table of shared digests, broadcast if it is small and joined by a shuffle if not.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    lo, hi, n = rows.agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // BUCKETS))
    bucket = F.coalesce(F.floor((F.col("page_id") - F.lit(lo or 0)) / width), F.lit(0)).cast("int")
    shards, start, parts, filled = 0, [0] * BUCKETS, [1] * BUCKETS, 0
    for b, size in rows.groupBy(bucket.alias("b")).agg(F.sum(F.octet_length("payload") + 512).alias("size")).orderBy("b").collect():
        if filled and filled + size > shard_bytes:
            shards, filled = shards + 1, 0
        start[b], parts[b] = shards, max(1, size // shard_bytes)
        filled += size
        if parts[b] > 1:
            shards, filled = shards + parts[b], 0
    keyed = rows.withColumn("sha", F.sha1("payload"))
    same = keyed.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha", "keeper")
    shared = Scratch(same, "warc-shared").read()
    if shared.count() * 64 <= broadcast_bytes:
        shared = F.broadcast(shared)
    pick = lambda values: F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), bucket + 1)
    shard = pick(start) + F.pmod(F.crc32("sha"), pick(parts)).cast("int")
    dealt = keyed.join(shared, "sha", "left").select(shard.alias("shard"), "page_id", "url", "payload", "keeper")
    tasks = max(1, min(shards + 1, 100_000))
    ordered = dealt.repartitionByRange(tasks, "shard") if tasks > 1 else dealt.coalesce(1)
    ordered = ordered.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "url", "payload")
    manifest = Scratch(ordered.mapInArrow(_writer(root, roll_bytes, level), FILES), "warc-manifest").read()
    total = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    if (total.records or 0) != n:
        raise RuntimeError(f"{total.records} of {n} records were written")
    return manifest


def records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-member stream, a member at a time."""
    z, held, waiting = None, [], b""
    for chunk in data:
        waiting += chunk
        while waiting:
            z = z or zlib.decompressobj(31)
            held.append(z.decompress(waiting))
            if not z.eof:
                waiting = b""
                break
            waiting = z.unused_data
            yield _parse(b"".join(held))
            z, held = None, []
    if z is not None:
        raise ValueError("the last record is cut off")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _reader(root: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "intact"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def rows(name: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{name}", compression=None) as f:
            for h, block in records(iter(lambda: f.read(1 << 20), b"")):
                if h["WARC-Type"] == "warcinfo":
                    continue
                digest, length, response = h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"]), h["WARC-Type"] == "response"
                intact = h["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}"
                if response:
                    payload = block.partition(b"\r\n\r\n")[2]
                    intact &= base32_sha1(payload) == digest
                    digest, length = base32_sha1(payload), len(payload)
                page = h["X-Page"]
                yield int(page) if page else None, length, digest, h["WARC-Type"], None if response else int(h["X-Refers-To-Page"]), h.get("WARC-Target-URI"), name, intact

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                held = []
                for row in rows(name):
                    held.append(row)
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return read


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """All records of the archives in manifest (RECORDS), digests taken anew and compared."""
    return manifest.select("file").repartition(max(1, min(manifest.count(), 100_000)), "file").mapInArrow(_reader(root), RECORDS)


def archive(pages: DataFrame, **options) -> DataFrame:
    """write() into a new folder under the shared scratch folder, then read()."""
    root = scratch_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, root, write(pages, root, **options))
