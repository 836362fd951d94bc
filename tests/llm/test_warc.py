import gzip

from pyspark.sql import functions as F

from trellis.llm import warc
from trellis.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, shard string, payload string"


def pages(spark):
    rows = [(k, f"http://h/{k}", "same" if k % 3 == 0 else f"page {k} " * 50, "clash", None) for k in range(40)]
    rows += [(100, None, None, None, None), (101, "http://a b\r\n/", "", None, None), (None, "http://n", "null id", None, None), (None, "http://n2", "same", None, None), (7, "http://h/7", "page 7 " * 50, "clash", None), (200, "u", "long " * 400_000, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(rows):
    last = {}
    for r in rows:
        last[r.html or ""] = max(last.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        k = last[r.html or ""]
        lone = k in (-1, r.page_id)
        out.append((r.page_id, len(body), warc.base32_sha1(body), "response" if lone else "revisit", None if lone else k))
    return sorted(out, key=str)


def names(spark, root):
    fs = spark._jvm.org.apache.hadoop.fs.Path(root)
    return sorted(s.getPath().getName() for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs) if not s.getPath().getName().startswith("."))


def test_round_trip_and_bytes_that_repeat(spark):
    df = pages(spark)
    seen = []
    for parts in (3, 1):
        root = scratch_path(spark, "warc-test")
        manifest = warc.write(df.repartition(parts), root, shard_bytes=20_000, roll_bytes=1500)
        got = warc.read(spark, root, manifest).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(df.collect())
        assert all(r.intact for r in got)
        files = {(r.shard, r.file): (r.sha256, r.bytes, r.records) for r in manifest.collect()}
        assert max(f[0] for f in files) > 2 and any(f[1].endswith("00001.warc.gz") for f in files)
        kept = names(spark, root)
        assert not [n for n in kept if n.startswith("_tmp")] and {f[1] for f in files} < set(kept)
        seen.append(files)
    assert seen[0] == seen[1]
    one = next(f[1] for f in seen[0])
    with gzip.open(root.removeprefix("file://") + "/" + one) as f:
        assert f.read(8) == b"WARC/1.1"


def test_empty_table_and_threshold(spark):
    assert warc.archive(pages(spark).filter(F.lit(False))).count() == 0
    kinds = {r.record_type for r in warc.archive(pages(spark), min_revisit_bytes=10**9).collect()}
    assert kinds == {"response"}
