"""Published versions and the stream that makes them."""

import pytest
from pyspark.sql import functions as F

from trellis.catalog import Index
from trellis.schemas import SCHEMA_VERSION
from trellis.sources import Conflict, collect_versions, manifest, publish, read_current, read_version
from trellis.sources.versions import Manifest, create_next, read_last
from trellis.streaming import index_batch, maintain_index, rebuilt_equals

SYMBOLS = "id long, project_id long, fqn string, file_path string, line_start int, signature string, signature_hash string"
REFS = "id long, symbol_id long, in_project_id long, file_path string, line int"
DDL = "root string, path string, change string, ts timestamp"


def index(spark, files=200, gone=(), changed=()):
    """Two symbols a file and references from each file to the next one's first symbol; changed files have another signature and a reference more."""
    names = [k for k in range(files) if k not in gone]
    sig = lambda k: "new" if k in changed else "old"
    symbols = [(10 * k + j, 1 + k % 3, f"T{k}.M{j}", f"/f{k}.cs", j, f"void M{j}()", sig(k) if j == 0 else "same") for k in names for j in range(2)]
    refs = [(1000 * k + j, 10 * ((k + 1) % files), 1 + k % 3, f"/f{k}.cs", j + (100 if k in changed else 0)) for k in names if (k + 1) % files not in gone for j in range(2 + (k in changed))]
    listing = [(k, 1 + k % 3, f"/f{k}.cs", sig(k)) for k in names]
    return Index(spark, {"symbols": spark.createDataFrame(symbols, SYMBOLS), "refs": spark.createDataFrame(refs, REFS), "file_index": spark.createDataFrame(listing, "id long, project_id long, file_path string, content_hash string")})


def size(path, name="data"):
    return sum(p.stat().st_size for p in (path / name).rglob("*.parquet"))


def test_a_publish_writes_what_changed(spark, tmp_path):
    root = str(tmp_path)
    assert publish(index(spark), root, buckets=100) == 1
    whole = size(tmp_path)
    second = index(spark, changed=(7, 8))
    assert publish(second, root) == 2
    assert size(tmp_path) - whole < 0.06 * whole
    assert rebuilt_equals(read_current(spark, root), second) and rebuilt_equals(read_version(spark, root, manifest(spark, root, 1)), index(spark))
    assert publish(second, root) == 3 and not list((tmp_path / "data").glob(f"{manifest(spark, root).number}/*"))
    last = index(spark, gone=(3, 4, 5), changed=(7,))
    publish(last, root)
    assert rebuilt_equals(read_current(spark, root), last) and read_current(spark, root).symbols.count() == 394


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    for changed in ((), (1,), (2,), (1, 2)):
        publish(index(spark, 40, changed=changed), root, buckets=10)
    assert collect_versions(spark, root, keep=2) == []  # too young
    before = size(tmp_path)
    assert collect_versions(spark, root, keep=2, min_age_s=0) and size(tmp_path) < before
    assert sorted(p.name for p in (tmp_path / "current").glob("[0-9]*")) == ["3", "4"]
    assert rebuilt_equals(read_current(spark, root), index(spark, 40, changed=(1, 2))) and rebuilt_equals(read_version(spark, root, manifest(spark, root, 3)), index(spark, 40, changed=(2,)))


def test_one_of_two_writers_is_told(spark, tmp_path):
    folder = str(tmp_path / "n")
    assert create_next(spark, folder, "one") == 1 and create_next(spark, folder, "two", after=1) == 2
    with pytest.raises(Conflict):
        create_next(spark, folder, "other", after=1)
    (tmp_path / "n" / "3").write_text("cut sh")
    assert read_last(spark, folder) == "two" and create_next(spark, folder, "four") == 4 and read_last(spark, folder) == "four"


def test_schemas_of_other_versions(spark, tmp_path):
    root = str(tmp_path)
    publish(index(spark, 5), root, buckets=3)
    m = manifest(spark, root)
    older = Manifest(0, SCHEMA_VERSION - 1, m.buckets, m.tables)
    create_next(spark, f"{root}/current", older.text())
    assert rebuilt_equals(read_current(spark, root), index(spark, 5))
    create_next(spark, f"{root}/current", Manifest(0, SCHEMA_VERSION + 1, m.buckets, m.tables).text())
    with pytest.raises(ValueError, match="schema"):
        read_current(spark, root)


def extractor(spark, after, asked=None):
    def extract(files):
        now = after()
        old = files.join(now.file_index.select("file_path", "project_id", "content_hash"), "file_path", "left")
        project = F.coalesce("project_id", (F.regexp_extract("file_path", r"\d+", 0).cast("long") % 3) + 1)
        changes = old.select(project.alias("project_id"), "file_path", "content_hash", F.when(F.col("content_hash").isNull(), "deleted").otherwise("changed").alias("change"))
        if asked is not None:
            asked.append(sorted(r.file_path for r in files.collect()))
        return changes, {t: now[t].join(files, "file_path", "left_semi") for t in ("symbols", "refs")}

    return extract


def test_a_batch_counts_once_and_cascades(spark, tmp_path):
    root, asked = str(tmp_path / "i"), []
    publish(index(spark, 30), root, buckets=8)
    after = index(spark, 30, changed=(4, 9), gone=(20,))
    sessions = spark.createDataFrame([(["/f4.cs", "/f9.cs"],), (["/f20.cs", "/f4.cs"],)], "paths array<string>")
    extract = extractor(spark, lambda: after, asked)
    assert index_batch(spark, root, sessions, 0, extract) == 2
    assert asked == [["/f20.cs", "/f4.cs", "/f9.cs"], ["/f3.cs", "/f8.cs"]]
    assert index_batch(spark, root, sessions, 0, extract) is None and manifest(spark, root).number == 2
    assert rebuilt_equals(read_current(spark, root), after)


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    """The first batch fails once its version is published, before the stream has noted it; then the stream begins anew."""
    from datetime import datetime, timedelta

    root, src, cp = str(tmp_path / "i"), str(tmp_path / "in"), str(tmp_path / "cp")
    publish(index(spark, 30), root, buckets=8)
    state = {"after": index(spark, 30, changed=(4,)), "fail": True}

    def extract(files):
        if manifest(spark, root).number > 1 and state["fail"]:
            raise AssertionError("a batch came twice")
        return extractor(spark, lambda: state["after"])(files)

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    put = lambda *r: spark.createDataFrame([("r", p, "changed", at(s)) for p, s in r], DDL).coalesce(1).write.mode("append").parquet(src)
    put(("/f4.cs", 0), ("/f4.cs", 0.1))
    changes = lambda: spark.readStream.schema(DDL).parquet(src)
    run = lambda: maintain_index(changes(), root, extract, cp, "200 milliseconds", "1 second")
    q = run()
    q.processAllAvailable()
    put(("/f9.cs", 60))
    q.processAllAvailable()
    q.stop()
    assert manifest(spark, root).number == 2 and rebuilt_equals(read_current(spark, root), state["after"])
    done = manifest(spark, root).batches["changes"]
    # forget that the last batches were done, as if the driver had died before it could say so
    for p in (tmp_path / "cp" / "commits").glob("*"):
        if p.name.lstrip(".").split(".")[0].isdigit() and int(p.name.lstrip(".").split(".")[0]) >= done:
            p.unlink()
    q = run()
    q.processAllAvailable()
    assert manifest(spark, root).number == 2
    state |= {"after": index(spark, 30, changed=(4, 9)), "fail": False}
    put(("/z.cs", 120))
    q.processAllAvailable()
    q.stop()
    assert manifest(spark, root).number == 3 and rebuilt_equals(read_current(spark, root), state["after"])
