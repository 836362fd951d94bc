"""Queries over the driver's tables, one an operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hpyp, jpeg, language, lines, mixing, phrases, pieces, quality, repair, simhash, vectors, warc
from .common import Scratch, fold_of, table


def op1_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp.score(table(spark, sf_dir, "documents"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return g.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, count_col="n_removed").select("doc_id", "text", "n_removed")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    p = quality.probabilities(docs, net)
    return p.select(F.col("id").alias("doc_id"), (fold_of("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.fit(table(spark, sf_dir, "documents")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(repair.prepared(repair.damage(table(spark, sf_dir, "conversations"))), "repair-rows").read()
    told = Scratch(repair.reports(rows), "repair-reports").read()
    return repair.with_hashes(told, repair.turns(rows, told))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(Scratch(chat.format_turns(rows), "chat").read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hpyp": op1_hpyp,
    "op2_vectors": op2_vectors,
    "op3_media": op3_media,
    "op4_lines": op4_lines,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_pieces": op9_pieces,
    "op10_language": op10_language,
    "op11_phrases": op11_phrases,
    "op12_repair": op12_repair,
    "op13_chat": op13_chat,
}
