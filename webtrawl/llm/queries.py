"""The queries of this subpackage, as registered in ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.llm import (
    exact_dedup,
    language_id,
    line_spread,
    mixing,
    near_dedup,
    packing,
    phrases,
    preferences,
    sentencepiece_codec,
    spotsigs,
    turn_trie,
    vector_dedup,
    warc,
)
from webtrawl.llm.common import table
from webtrawl.sources.scratch import scratch_path


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbours(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preferences(table(spark, sf_dir, "conversations"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.clean(docs).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    found = language_id.predict(docs.drop("lang"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.languages").alias("languages"),
        F.col("found.weights").alias("proportions"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("links").alias("links_used"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, mark = scratch_path(spark, "warc"), warc.new_mark()
    warc.write(warc.chunks(warc.records(table(spark, sf_dir, "pages"))), path, mark)
    found = warc.check(warc.read(spark, path, mark))
    return found.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("bigint").alias("refers_to"),
        "intact",
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.nodes(table(spark, sf_dir, "conversations"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: build
        for name, build in sorted(globals().items())
        if name.startswith("op") and callable(build)
    }
