"""Index build: pages to clean documents, token lists and a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.functions.html import exact_text, page_text
from webtrawl.operators.search import corpus_size, document_frequency, postings, tokenise


SCHEMAS = {
    "documents": "url string, tokens array<string>, n_tokens int",
    "before": "url string, tokens array<string>, n_tokens int",
    "postings": "term string, url string, pos int, n_tokens int, bucket int",
    "terms": "term string, documents bigint, bucket int",
    "corpus": "corpus bigint, mean_length double",
    "replaced": "url string",
}


@dataclass(frozen=True)
class Index:
    """A stored index below ``path``.

    - ``documents``: url, tokens, n_tokens;
    - ``postings``: term, url, pos, n_tokens, in folders by term bucket;
    - ``terms``: term, documents, in folders by term bucket;
    - ``corpus``: one row with the number of documents and their mean length.
    """

    spark: SparkSession
    path: str
    buckets: int

    def table(self, name: str) -> DataFrame:
        # A table without rows has no folders to read the columns from.
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of ``terms`` in a table kept by bucket: other folders are not read."""
        buckets = [term_bucket(F.lit(t), self.buckets) for t in terms]
        return self.table(name).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def documents_of(
    pages: DataFrame, exact: bool = False, decode: bool = True, **options
) -> DataFrame:
    """(url, content) of (url, html), entities decoded.

    ``exact`` reads markup that patterns may misread with a parser, and adds
    ``error`` for pages that it refuses; these have no content.
    """
    html = F.col("html")
    if exact:
        return pages.select("url", exact_text(html).alias("_text")).select("url", "_text.*")
    return pages.select("url", page_text(html, decode, **options).alias("content"))


def build_index(documents: DataFrame, path: str, buckets: int) -> Index:
    """Write the index of (url, content) below ``path``.

    Text is tokenised once; the other tables are made from the stored tokens.
    """
    index = Index(documents.sparkSession, path, buckets)
    tokenise(documents).write.parquet(f"{path}/documents")
    stored = index.table("documents")
    write_postings(stored, document_frequency(stored), index)
    corpus_size(stored).write.parquet(f"{path}/corpus")
    return index


def write_postings(stored: DataFrame, counts: DataFrame, index: Index) -> None:
    """Write the postings of stored documents, and (term, documents), by term bucket."""
    bucket = term_bucket(F.col("term"), index.buckets)
    # Rebalanced: a bucket with a term found everywhere goes to as many tasks and
    # files as its size asks for, and small buckets share one task.
    (
        postings(stored)
        .withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket")
        .parquet(f"{index.path}/postings")
    )
    (
        counts.withColumn("bucket", bucket)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket")
        .parquet(f"{index.path}/terms")
    )
