"""Phrase search against a plain scan."""

import math
import random
from itertools import pairwise

import pytest

from webtrawl.operators import search
from webtrawl.plans import index as index_plan
from webtrawl.plans import search as search_plans

WORDS = ["the", "of", "a", "cat", "it's", "3.14"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = {f"u{i}": [rng.choice(WORDS) for _ in range(rng.randrange(0, 90))] for i in range(40)}
    # A passage longer than several blocks, whole in two documents, broken in a third.
    long = [rng.choice(WORDS) for _ in range(50)]
    docs["whole"] = ["x", *long, "y"]
    docs["twice"] = [*long, *long]
    docs["broken"] = [*long[:25], "other", *long[25:]]
    return docs, long


@pytest.fixture(scope="module")
def documents(spark, corpus):
    rows = [(u, " ".join(t)) for u, t in corpus[0].items()]
    return spark.createDataFrame(rows, "url string, content string")


def occurrences(tokens, terms):
    return sum(tokens[i : i + len(terms)] == terms for i in range(len(tokens) - len(terms) + 1))


def expected_hits(docs, terms):
    n = len(docs)
    mean = sum(map(len, docs.values())) / n
    held = {t: sum(t in d for d in docs.values()) for t in set(terms)}
    weight = sum(math.log1p((n - held[t] + 0.5) / (held[t] + 0.5)) for t in terms)
    scores = []
    for url, tokens in docs.items():
        tf = occurrences(tokens, terms)
        if tf:
            norm = 1.2 * (1 - 0.75 + 0.75 * len(tokens) / mean)
            scores.append((url, round(weight * tf / (tf + norm), 6)))
    return sorted(scores, key=lambda s: (-s[1], s[0]))


def queries_of(docs, long):
    return [
        "the",
        "the of",
        "The  OF, a",
        "the the",
        "the the the",
        "it's 3.14",
        "no such phrase",
        "cat of the a",
        " ".join(long[:16]),
        " ".join(long[:17]),
        " ".join(long[:32]),
        " ".join(long),
        " ".join([*long, "y"]),
        "",
        "--",
    ]


@pytest.mark.parametrize("task_rows", [search.TASK_ROWS, 5])
def test_search_requests(spark, corpus, documents, task_rows):
    docs, long = corpus
    asked = [(i, q, 1 + i % 7, (i % 3) * 99) for i, q in enumerate(queries_of(docs, long) * 3)]
    requests = spark.createDataFrame(asked, "request_id int, q string, size int, start bigint")
    got = {}
    hits = search.search_requests(search.tokenise(documents), requests, task_rows)
    for r in hits.collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.url, pytest.approx(r.score, abs=2e-6))
    for i, q, size, start in asked:
        terms = q.lower().replace(",", "").replace("--", "").split()
        expected = expected_hits(docs, terms) if terms else []
        page = dict(enumerate(expected, 1))
        page = {k: v for k, v in page.items() if start < k <= start + size}
        assert got.get(i, {}) == page, q


def test_search_phrase_on_a_stored_index(corpus, documents, tmp_path):
    docs, long = corpus
    index = index_plan.build_index(documents, str(tmp_path / "index"), buckets=4)
    for q in queries_of(docs, long):
        terms = q.lower().replace(",", "").replace("--", "").split()
        expected = expected_hits(docs, terms) if terms else []
        got = [(r.url, r.score) for r in search_plans.search_phrase(index, q, 100).collect()]
        assert [u for u, _ in got] == [u for u, _ in expected], q
        assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=2e-6)
    got = [r.url for r in search_plans.search_phrase(index, "the", 3, start=2).collect()]
    assert got == [u for u, _ in expected_hits(docs, ["the"])[2:5]]


def test_index_reads_only_the_buckets_of_its_terms(documents, tmp_path):
    index = index_plan.build_index(documents, str(tmp_path / "index"), buckets=64)
    found = index.of_terms("postings", ["cat"])
    (line,) = [x for x in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in x][-1:]
    assert "PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,cat)" in line or "In(term" in line
    assert {r.term for r in found.collect()} == {"cat"}


@pytest.mark.parametrize("words", [["the"], ["the", "of"], ["of the"], ["nowhere"], []])
def test_few_phrases(spark, corpus, documents, words):
    """Single terms only, short phrases only, or nothing to search for."""
    rows = [(i, q, 100, 0) for i, q in enumerate(words)]
    requests = spark.createDataFrame(rows, "request_id int, q string, size int, start bigint")
    got = search.search_requests(search.tokenise(documents), requests).collect()
    for i, q in enumerate(words):
        expected = [u for u, _ in expected_hits(corpus[0], q.split())]
        page = sorted((r["rank"], r.url) for r in got if r.request_id == i)
        assert [u for _, u in page] == expected
    assert words or not got


def test_postings(documents, corpus):
    rows = search.postings(search.tokenise(documents)).where("url = 'twice'").orderBy("pos").collect()
    assert [r.term for r in rows] == corpus[0]["twice"]
    assert all(b.pos == a.pos + 1 for a, b in pairwise(rows))


def test_large_query_sets_are_not_broadcast(spark, corpus, documents, monkeypatch):
    docs, long = corpus
    monkeypatch.setattr("webtrawl.sources.scratch.BROADCAST_ROWS", 0)
    asked = [(i, q, 100, 0) for i, q in enumerate(queries_of(docs, long))]
    requests = spark.createDataFrame(asked, "request_id int, q string, size int, start bigint")
    hits = search.search_requests(search.tokenise(documents), requests).collect()
    for i, q, *_ in asked:
        terms = q.lower().replace(",", "").replace("--", "").split()
        expected = {u for u, _ in expected_hits(docs, terms)} if terms else set()
        assert {r.url for r in hits if r.request_id == i} == expected
