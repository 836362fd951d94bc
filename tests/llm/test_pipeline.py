"""The stages of the pipeline, each against a plain version on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from trellis.llm import mixing, quality  # noqa: E402
from trellis.llm.common import Scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(stage(spark, seen[-1], SF), "test").read()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out)
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = quality.score(net, [r.text.encode() for r in rows[0].values()])
    assert set(rows[1]) == {i for i, s in zip(rows[0], score, strict=True) if s >= 0.3}
    assert set(rows[2]) == set(rows[1]) and all(len(rows[2][i].text) == rows[2][i].n_chars <= len(rows[1][i].text) for i in rows[2])
    assert set(rows[3]) <= set(rows[2])
    copies = {r.id: r.copies for r in mixing.plan(seen[3]).collect()}
    assert {r.doc_id: r["count"] for r in seen[4].groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    assert seen[5].count() == seen[4].count() and all(r.intact for r in rows[5].values())


def test_stages_send_few_texts_to_python(spark):
    """Before, a task sent 10,000 texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
        for name, stage in corpus_pipeline.STAGES:
            if name in ("quality classifier", "SimHash near-dedup", "SentencePiece encoding and decoding"):
                spark.conf.set(key, "10000")
                stage(spark, docs, SF)
                assert int(spark.conf.get(key)) <= 1000, name
    finally:
        spark.conf.set(key, before)
