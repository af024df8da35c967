"""Search: one phrase on a stored index, or a table of requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.functions.text import tokens
from webtrawl.operators.requests import search_requests as check_requests
from webtrawl.operators.requests import split_by_status
from webtrawl.operators.search import bm25, idf, page_of_hits, postings_hits, search_requests
from webtrawl.plans.index import Index
from webtrawl.sources.scratch import BROADCAST_ROWS, broadcast_if_small, materialize


def query_terms(spark: SparkSession, q: str) -> list[str]:
    """The tokens of ``q``, made by the same function as those of the documents."""
    return spark.range(1).select(tokens(F.lit(q)).alias("terms")).first()["terms"]


def search_phrase(index: Index, q: str, size: int, start: int = 0) -> DataFrame:
    """One page of (url, score) for the phrase ``q``, best first.

    Reads only the folders of its terms; lengths and corpus size are stored, so
    no table is read whole.  A phrase with an unknown term, or without any
    token, has no hits.
    """
    terms = query_terms(index.spark, q)
    # One row for each term of the phrase.
    known = index.of_terms("terms", terms).collect() if terms else []
    if not terms or len(known) < len(set(terms)):
        return index.spark.createDataFrame([], "url string, score double")
    documents = {r["term"]: r["documents"] for r in known}
    corpus, mean_length = index.table("corpus").first()
    weight = sum((idf(F.lit(documents[t]), corpus) for t in terms), F.lit(0.0))
    score = bm25(weight, F.col("frequency"), F.col("n_tokens"), mean_length)
    found = index.of_terms("postings", terms)
    rarest = min(documents, key=documents.get)
    if len(documents) > 1 and documents[rarest] <= BROADCAST_ROWS:
        # The phrase is only where its rarest term is, on so many urls at most.
        urls = materialize(index.of_terms("postings", [rarest]).select("url").distinct(), "urls")
        found = found.join(broadcast_if_small(urls, "url"), "url", "left_semi")
    hits = postings_hits(found, terms)
    return page_of_hits(hits.select("url", score.alias("score")), size, start)


def search_batch(documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of a table of raw requests on tokenised documents, and the requests refused."""
    accepted, refused = split_by_status(check_requests(requests))
    return search_requests(documents, accepted), refused
