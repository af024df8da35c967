"""Phrase search: token tables, phrase matches, relevance, paging.

Matching compares whole runs of tokens.  A filter of all phrases, of bounded size,
tells which runs of a document may equal one (``operators/runs.py``); these then
equal a phrase or do not.  No pairs of partial matches arise, so the joins give
real hits only, however common the single words are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.text import phrase, tokens
from webtrawl.functions.times import floor_div
from webtrawl.operators.ordered import TASK_ROWS, rank_rows
from webtrawl.operators.requests import LARGEST, MAX_LIMIT
from webtrawl.operators.runs import possible_runs
from webtrawl.sources.scratch import fits_broadcast, materialize

# BM25 parameters; scores are compared at this many digits.
K1 = 1.2
B = 0.75
DIGITS = 6

# Tokens of a phrase compared at once.
BLOCK = 16


def tokenise(documents: DataFrame) -> DataFrame:
    """(url, tokens, n_tokens) of (url, content)."""
    return documents.select("url", tokens(F.col("content")).alias("tokens")).withColumn(
        "n_tokens", F.size("tokens")
    )


def postings(tokenised: DataFrame) -> DataFrame:
    """(term, url, pos, n_tokens) for each token; no rows move.

    The document's length goes along, so that scoring needs no lookup of it.
    """
    # The inner form would test for empty lists first, and so tokenise twice.
    each = F.posexplode_outer("tokens").alias("pos", "term")
    return (
        tokenised.select("url", "n_tokens", each)
        .where(F.col("term").isNotNull())
        .select("term", "url", "pos", "n_tokens")
    )


def document_frequency(tokenised: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Documents holding each term, or each of the ``wanted`` (term) only.

    Terms are made distinct inside the document and counted before they move.
    """
    terms = tokenised.select(F.explode(F.array_distinct("tokens")).alias("term"))
    if wanted is not None:
        terms = terms.join(wanted, "term", "left_semi")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def corpus_size(tokenised: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return tokenised.agg(
        F.count(F.lit(1)).alias("corpus"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("mean_length")
    )


def idf(documents: Column, corpus: int) -> Column:
    return F.log1p((F.lit(corpus) - documents + 0.5) / (documents + 0.5))


def bm25(weight: Column, frequency: Column, length: Column, mean_length: float) -> Column:
    """Relevance of a phrase found ``frequency`` times; ``weight`` is the sum of its terms' idf."""
    norm = K1 * (1 - B + B * length / F.lit(mean_length))
    return F.round(weight * frequency / (frequency + norm), DIGITS)


def asked_phrases(queries: DataFrame) -> DataFrame:
    """``queries`` with the tokens of ``q`` and their phrase; those without a token drop out."""
    return (
        queries.withColumn("terms", tokens(F.col("q")))
        .where(F.size("terms") > 0)
        .withColumn("phrase", phrase(F.col("terms")))
    )


def phrase_blocks(phrases: DataFrame) -> DataFrame:
    """(phrase, blocks, offset, block): phrases longer than a block, cut into several.

    The last one is aligned to the phrase's end; a phrase is found where all its
    blocks are found at their offsets.
    """
    count = F.ceil(F.col("length") / BLOCK).cast("int")
    last = F.col("length") - BLOCK
    return (
        phrases.withColumn("blocks", count)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("offset", F.least(F.col("_j") * BLOCK, last))
        .select(
            "phrase",
            "blocks",
            "offset",
            phrase(F.slice("terms", F.col("offset") + 1, F.lit(BLOCK))).alias("block"),
        )
    )


def short_counts(tokenised: DataFrame, short: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(phrase, url, n_tokens, frequency) of the phrases in ``short``, of up to a block's tokens.

    Counts are combined before they move, and then spread by (phrase, url), so a
    phrase found everywhere is no single task's work.  Some rows are of runs that
    are no phrase: the filter let them through.
    """
    runs = possible_runs(tokenised, short.select(F.col("phrase").alias("block")), lengths)
    return runs.groupBy(F.col("block").alias("phrase"), "url", "n_tokens").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def long_counts(tokenised: DataFrame, blocks: DataFrame) -> DataFrame:
    """(phrase, url, n_tokens, frequency) of phrases that are cut into ``blocks``."""
    runs = possible_runs(tokenised, blocks.select("block").distinct(), [BLOCK])
    start = F.col("pos") - F.col("offset")
    return (
        runs.join(blocks, "block")
        .groupBy("phrase", "url", "n_tokens", "blocks", start.alias("_start"))
        .agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") == F.col("blocks"))
        .groupBy("phrase", "url", "n_tokens")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def score_phrases(tokenised: DataFrame, asked: DataFrame) -> DataFrame:
    """(phrase, url, score) of every document that holds a phrase in ``asked`` (phrase, terms).

    The documents are only scanned, whether phrases are few or many: what moves are
    the runs that a filter of the phrases lets through, and counts of terms.
    """
    distinct = asked.groupBy("phrase").agg(F.any_value("terms").alias("terms"))
    phrases = materialize(distinct.withColumn("length", F.size("terms")), "phrases")
    size = phrases.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("bytes"),
        F.collect_set(F.when(F.col("length") <= BLOCK, F.col("length"))).alias("lengths"),
        F.coalesce(F.max("length"), F.lit(0)).alias("longest"),
    ).first()
    few = fits_broadcast(size["tokens"], size["bytes"])

    parts = []
    if size["lengths"]:
        parts.append(short_counts(tokenised, phrases.where(F.col("length") <= BLOCK), sorted(size["lengths"])))
    if size["longest"] > BLOCK:
        blocks = materialize(phrase_blocks(phrases.where(F.col("length") > BLOCK)), "blocks")
        parts.append(long_counts(tokenised, F.broadcast(blocks) if few else blocks))
    if not parts:
        return phrases.select("phrase", F.lit("").alias("url"), F.lit(0.0).alias("score"))
    counts = reduce(DataFrame.unionByName, parts)

    corpus, mean_length = corpus_size(tokenised).first()
    terms = phrases.select("phrase", F.explode("terms").alias("term"))
    # Many terms meet the counts of all, a row for each term, instead of the documents.
    wanted = F.broadcast(terms.select("term").distinct()) if few else None
    weights = (
        document_frequency(tokenised, wanted)
        .join(terms, "term")
        .groupBy("phrase")
        .agg(F.sum(idf(F.col("documents"), corpus)).alias("weight"))
    )
    score = bm25(F.col("weight"), F.col("frequency"), F.col("n_tokens"), mean_length)
    # Only phrases have a weight: here the runs that are none drop out.
    return materialize(
        counts.join(weights, "phrase").select("phrase", "url", score.alias("score")), "hits"
    )


def rank_hits(hits: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Best score first, equal scores by url."""
    return rank_rows(hits, keys, [F.desc("score"), F.asc("url")], "rank", task_rows)


def page_of_hits(hits: DataFrame, size: int, start: int = 0) -> DataFrame:
    """One page of one query's hits."""
    return hits.orderBy(F.desc("score"), "url").offset(start).limit(size)


def search_requests(
    tokenised: DataFrame, requests: DataFrame, task_rows: int = TASK_ROWS
) -> DataFrame:
    """(request_id, rank, url, score) for each accepted request's page of hits.

    ``requests`` has request_id, q, size and start.  A text asked for by many
    requests is split into tokens and searched once.  Ranks are cut into strips as
    long as the largest page: a page meets the hits of the two strips it may touch,
    however many hits there are.  Only then do the requests meet their pages.
    """
    # The end of a page must be a number too; no list of hits is so long.
    start = F.least("start", F.lit(LARGEST - MAX_LIMIT)).alias("start")
    # Read three times below.
    asked = materialize(requests.select("request_id", "q", start, "size"), "asked")
    # Written out, or the test for tokens would be made on every request, before the texts are distinct.
    texts = materialize(asked.select("q").distinct(), "texts")
    queries = materialize(asked_phrases(texts), "queries")
    page = ["q", "start", "size"]

    def strip(place: Column) -> Column:
        return floor_div(place, MAX_LIMIT)

    last = F.col("start") + F.col("size") - 1
    touched = F.array_distinct(F.array(strip(F.col("start")), strip(last)))
    pages = (
        asked.select(*page)
        .distinct()
        .join(queries.select("q", "phrase"), "q")
        .withColumn("strip", F.explode(touched))
    )
    ranked = rank_hits(score_phrases(tokenised, queries), ["phrase"], task_rows)
    shown = pages.join(ranked.withColumn("strip", strip(F.col("rank") - 1)), ["phrase", "strip"]).where(
        (F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.col("size"))
    )
    return asked.join(shown, page).select("request_id", "rank", "url", "score")


def postings_hits(postings_table: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(url, n_tokens, frequency) of a phrase, from a stored postings table.

    Each posting of the j-th term votes for the start ``pos - j``; a start with
    a vote from every term is a match.  Votes are grouped by (url, start), so a
    common term spreads over its documents.
    """
    places: dict[str, list[int]] = {}
    for j, term in enumerate(terms):
        places.setdefault(term, []).append(j)
    offsets = F.create_map(
        *[x for t, js in places.items() for x in (F.lit(t), F.array(*[F.lit(j) for j in js]))]
    )
    return (
        postings_table.where(F.col("term").isin(*places))
        .select("url", "n_tokens", "pos", F.explode(offsets[F.col("term")]).alias("j"))
        .groupBy("url", "n_tokens", (F.col("pos") - F.col("j")).alias("start"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .where(F.col("votes") == len(terms))
        .groupBy("url", "n_tokens")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
