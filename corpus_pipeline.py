"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtrawl.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from webtrawl.sources.scratch import materialize


# Rows of the batches that tasks hand to Python.  Texts are long: ten thousand of
# them, Spark's default, take tens of megabytes on both sides of each task.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null and letterless texts go."""
    small_batches(spark)
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, upper and lower case A-Z being equal; the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; the smallest doc_id stays."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a repeated one keeps its doc_id."""
    small_batches(spark)
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with their digests; decoded_sha256 shows that nothing was lost."""
    small_batches(spark)
    return sentencepiece_codec.encode_digests(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Language inference, weighted sampling and SentencePiece are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
