"""A crawl over many batches reaches what a crawl in one go reaches."""

import json
import random

import pytest

from webtrawl.plans.crawl import crawl
from webtrawl.streaming import frontier
from webtrawl.streaming.run import each_batch


def test_crawl_over_many_batches(spark, tmp_path):
    """A few urls a batch; cut off in the middle of one, and started again."""
    draw = random.Random(6)
    roots = [f"https://r{k}.example" for k in range(3)] + ["https://gone.example"]
    graph = {}
    for root in roots[:3]:
        graph[root] = [str(draw.randrange(12)) for _ in range(3)]
        for page in range(9):
            graph[f"{root}/{page}"] = [str(draw.randrange(12)) for _ in range(3)] + [root, "https://out.example"]
    pages = spark.createDataFrame(list(graph.items()), "url string, hrefs array<string>")
    table = frontier.frontier_table(spark, str(tmp_path / "frontier"))
    handle = frontier.crawl_handler(table, pages, urls_of_a_root=4)
    folder, runs = tmp_path / "in", []
    folder.mkdir()

    def fails_once(batch, batch_id):
        handle(batch, batch_id)
        runs.append(batch_id)
        if runs == [0, 1]:
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema("root string").option("maxFilesPerTrigger", 1).json(str(folder))
        each_batch(stream, fails_once, str(tmp_path / "checkpoint"), every=None).awaitTermination()

    begin = [roots[:2], [None], roots[1:], [None], [None], [None]]
    for k, names in enumerate(begin):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"root": r}) for r in names))
    with pytest.raises(Exception, match="lost"):
        run()
    assert not frontier.is_done(table)
    run()
    assert runs == [0, 1, 1, 2, 3, 4, 5]
    assert frontier.is_done(table)
    got = sorted(tuple(r) for r in table.current().select("root", "url", "depth", "state").collect())
    seeds = spark.createDataFrame([(r,) for r in roots], "root string")
    assert got == sorted(tuple(r) for r in crawl(seeds, pages).select("root", "url", "depth", "state").collect())
