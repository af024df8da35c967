"""Runs of tokens found through the filter of phrases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webtrawl.operators import runs, search

TOKENISED = "url string, tokens array<string>, n_tokens int"


def table(spark, docs):
    return spark.createDataFrame([(u, t, len(t)) for u, t in docs], TOKENISED)


def found(spark, docs, phrases, lengths):
    wanted = spark.createDataFrame([(" ".join(p),) for p in phrases], "block string")
    rows = runs.possible_runs(table(spark, docs), wanted, lengths).collect()
    assert all(r.n_tokens == len(dict(docs)[r.url]) for r in rows)
    return Counter((r.url, r.pos, r.block) for r in rows)


def expected(docs, phrases):
    return Counter(
        (u, i, " ".join(p)) for u, t in docs for p in phrases for i in range(len(t)) if t[i : i + len(p)] == p
    )


@pytest.mark.parametrize("chunk", [runs.CHUNK, 50])
def test_every_run_that_equals_a_phrase(spark, monkeypatch, chunk):
    """In documents of several pieces too, and where a run lies over the end of a piece."""
    monkeypatch.setattr(runs, "PIECE", 32)
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rng = random.Random(5)
    docs = [(f"u{i}", [rng.choice("abcdé") for _ in range(rng.choice([0, 1, 2, 31, 32, 33, 64, 150]))]) for i in range(60)]
    phrases = [list(p) for p in ("a", "bc", "aba", "décab", "x")] + [docs[-1][1][20:36], docs[-2][1][:16]]
    phrases = [p for p in phrases if p]
    got = found(spark, docs, phrases, sorted({len(p) for p in phrases}))
    want = expected(docs, phrases)
    assert all(got[k] == n for k, n in want.items())
    assert got.total() - want.total() <= want.total() / 100


def test_few_runs_of_common_words_move(spark):
    """Every place begins like a phrase, and no run equals one: nothing is sent on."""
    docs = [(f"u{i}", ["of", "the"] * 500) for i in range(8)]
    phrases = [["of", "the", f"w{i}"] for i in range(300)] + [["the", "of", f"w{i}", "the"] for i in range(300)]
    assert found(spark, docs, phrases, [3, 4]).total() <= 8


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(runs, "MAX_BLOCKS", 1)
    monkeypatch.setattr(runs, "BITS_PER_PHRASE", 1)
    words = [f"w{i}" for i in range(40_000)]
    docs = [("u", words[:2000]), ("v", [f"x{i}" for i in range(2000)])]
    got = found(spark, docs, [[w] for w in words], [1])
    assert all((("u", i, w)) in got for i, w in enumerate(words[:2000]))
    assert any(u == "v" for u, *_ in got)
    content = spark.createDataFrame([(u, " ".join(t)) for u, t in docs], "url string, content string")
    requests = spark.createDataFrame(
        [(i, w, 5, 0) for i, w in enumerate(words)], "request_id int, q string, size int, start bigint"
    )
    hits = search.search_requests(search.tokenise(content), requests).collect()
    assert sorted(r.request_id for r in hits) == list(range(2000)) and {r.url for r in hits} == {"u"}


def test_documents_do_not_move_to_many_phrases(spark, monkeypatch):
    """However many phrases there are, their counts are made before the first shuffle."""
    monkeypatch.setattr("webtrawl.sources.scratch.BROADCAST_ROWS", 0)
    short = spark.createDataFrame([("of the", ["of", "the"], 2)], "phrase string, terms array<string>, length int")
    counts = search.short_counts(table(spark, [("u", ["of", "the", "of", "the"])]), short, [2])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert [tuple(r) for r in counts.collect()] == [("of the", "u", 4, 2)]


def test_repeated_documents_count_each(spark):
    """A long phrase in the same batch does not lose the hits of a document that comes twice."""
    rows = [("u", "of the cat"), ("u", "of the cat"), ("v", "of the dog")]
    content = spark.createDataFrame(rows, "url string, content string")
    asked = [(1, "of the", 10, 0), (2, " ".join(["cat"] * 20), 10, 0)]
    requests = spark.createDataFrame(asked, "request_id int, q string, size int, start bigint")
    hits = search.search_requests(search.tokenise(content), requests).select("request_id", "rank", "url")
    assert sorted(map(tuple, hits.collect())) == [(1, 1, "u"), (1, 2, "v")]


def test_texts_of_one_phrase_share_its_hits(spark):
    """Tokens are made of the distinct texts; two texts may be one phrase."""
    content = spark.createDataFrame([("u", "of the cat"), ("v", "The Cat")], "url string, content string")
    texts = ["the cat", "The  CAT", "of", "--"]
    asked = spark.range(400).select(
        F.col("id").alias("request_id"),
        F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("q"),
        F.lit(1).alias("size"),
        F.lit(0).cast("bigint").alias("start"),
    )
    hits = search.search_requests(search.tokenise(content), asked).collect()
    assert Counter((r.request_id % 4, r["rank"], r.url) for r in hits) == {
        (0, 1, "v"): 100, (1, 1, "v"): 100, (2, 1, "u"): 100
    }
