"""Corpus pipeline: five stages over documents, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import lines, mixing, pieces, quality, simhash
from trellis.llm.common import Scratch, table


def few_texts(spark: SparkSession) -> None:
    """Texts go to Python 1,000 at once from here on; by the usual 10,000 a task sends its whole split, which both processes hold."""
    spark.conf.set(*pieces.BATCH[:2])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (probability of good quality at least 0.3)."""
    few_texts(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is similar to; n_chars follows."""
    return lines.dedup(docs, length_col="n_chars")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    few_texts(spark)
    return simhash.keep_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that the mix holds."""
    few_texts(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: A learned classifier isn't expressed in SQL; tests compare with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        written = Scratch(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if before is not None:
            before.drop()
        docs, before = written.read(), written
    return STAGES[-1][1](spark, docs, sf_dir)
