"""Crawl expansion against a plain breadth-first walk."""

import random

import pytest
from pyspark.sql import functions as F

from webtrawl.plans import crawl
from webtrawl.sources import pages as page_source


def walk(graph, root, max_depth):
    depths, queue = {root: 0}, [root]
    for url in queue:
        if depths[url] < max_depth and url in graph:
            for href in graph[url]:
                link = f"{root}/{href}"
                if link not in depths:
                    depths[link] = depths[url] + 1
                    queue.append(link)
    return {
        u: (d, "unvisited" if d == max_depth else "fetched" if u in graph else "failed")
        for u, d in depths.items()
    }


@pytest.mark.parametrize("max_depth,broadcast", [(0, True), (1, True), (3, True), (5, True), (3, False)])
def test_crawl(spark, monkeypatch, max_depth, broadcast):
    if not broadcast:
        monkeypatch.setattr("webtrawl.sources.scratch.BROADCAST_ROWS", -1)
    rng = random.Random(max_depth)
    roots = [f"https://r{i}.example" for i in range(6)]
    graph = {}
    for root in roots[:5]:
        graph[root] = [str(rng.randrange(40)) for _ in range(3)]
        for page in range(30):
            graph[f"{root}/{page}"] = [str(rng.randrange(40)) for _ in range(4)]
    pages = spark.createDataFrame(list(graph.items()), "url string, hrefs array<string>")
    seeds = spark.createDataFrame([(r,) for r in roots] + [(roots[0],)], "root string")
    got = {}
    for r in crawl.crawl(seeds, pages, max_depth).collect():
        assert r.url not in got.setdefault(r.root, {})
        got[r.root][r.url] = (r.depth, r.state)
    assert got == {root: walk(graph, root, max_depth) for root in roots}


def test_root_linked_to(spark):
    root = "https://r.example"
    pages = spark.createDataFrame([(root, [root]), (root + "/a", ["a"])], "url string, hrefs array<string>")
    seeds = spark.createDataFrame([(root,)], "root string")
    once = crawl.crawl(seeds, pages).collect()
    again = crawl.crawl(seeds, pages, refetch_root=True).collect()
    assert [(r.url, r.depth) for r in once] == [(root, 0)]
    assert sorted((r.url, r.depth) for r in again) == [(root, 0), (root, 1)]


@pytest.mark.parametrize("rows", [0, 100])
def test_newest_versions(spark, monkeypatch, rows):
    monkeypatch.setattr("webtrawl.sources.scratch.BROADCAST_ROWS", rows)
    versions = [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")]
    pages = spark.createDataFrame(versions, "url string, version int, html string")
    got = page_source.newest_versions(pages, "version").collect()
    assert sorted((r.url, r.html) for r in got) == [("a", "new"), ("b", "only")]


def test_fetch(spark):
    frontier = spark.createDataFrame([("r", "a"), ("r", "b")], "root string, url string")
    pages = spark.createDataFrame([("a", "<p>", 1)], "url string, html string, other int")
    fetched, failed = page_source.fetch(frontier, pages, ["html"])
    assert [tuple(r) for r in fetched.select("root", "url", "html").collect()] == [("r", "a", "<p>")]
    assert [r.url for r in failed.collect()] == ["b"]


def test_pruned_scans(spark, sf_dir):
    """A two-column job reads two columns, and a filter reaches the files."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    frontier = spark.createDataFrame([("r", "a")], "root string, url string")
    _, failed = page_source.fetch(frontier, pages)
    assert "html" not in failed._jdf.queryExecution().executedPlan().toString()
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_nationkey") == 7)
    plan = customers._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,7)" in plan
