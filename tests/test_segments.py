"""An index of segments gives what an index built anew gives."""

import json
import random

import pytest

from webtrawl.plans import index as index_plan
from webtrawl.plans import search as search_plans
from webtrawl.plans.segments import SegmentedIndex, index_handler
from webtrawl.streaming.run import each_batch

WORDS = ["the", "cat", "sat", "on", "a", "mat", "dog"]
QUERIES = ["the", "the cat", "gone"]


def written(draw):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randrange(12)))


def rebuilt(spark, docs, path):
    frame = spark.createDataFrame(sorted(docs.items()), "url string, content string")
    return index_plan.build_index(frame, path, buckets=4)


def hits(found):
    return [(r.url, r.score) for r in found.collect()]


def test_segments_are_like_a_rebuild(spark, tmp_path):
    """After inserts, replacements, deletions and merges."""
    draw = random.Random(4)
    index = SegmentedIndex(spark, str(tmp_path / "index"), 4).start()
    assert hits(index.search("the", 10)) == []
    docs = {}
    for step in range(6):
        batch = {f"u{draw.randrange(25)}": written(draw) for _ in range(8)}
        deleted = {f"u{draw.randrange(25)}" for _ in range(3)} - set(batch)
        if step == 0:
            batch["only"] = "gone tomorrow"
        if step == 2:
            deleted.add("only")
        frame = spark.createDataFrame(sorted(batch.items()), "url string, content string")
        index.append(frame, spark.createDataFrame([(u,) for u in sorted(deleted)], "url string"))
        docs = {u: t for u, t in docs.items() if u not in deleted} | batch
        if step in (3, 5):
            before = {s.name for s in index.manifest()[1]}
            assert index.merge(fan=2) == 2
            _, segments = index.manifest()
            assert len(segments) == len(before) - 1
            # What was merged is not read any more.
            merged = before - {s.name for s in segments}
            assert len(merged) == 2
            assert not any(name in file for file in index.documents().inputFiles() for name in merged)
        if step in (1, 5):
            anew = rebuilt(spark, docs, str(tmp_path / f"anew-{step}"))
            for q in QUERIES:
                wanted = hits(search_plans.search_phrase(anew, q, 100))
                got = hits(index.search(q, 100))
                assert [u for u, _ in got] == [u for u, _ in wanted], q
                assert [s for _, s in got] == pytest.approx([s for _, s in wanted], abs=2e-6)
    now = {r.url for r in index.documents().collect()}
    assert now == set(docs)


def test_pages_come_as_segments(spark, tmp_path):
    """A batch that runs again is not added twice; a lost writer leaves no version."""
    index = SegmentedIndex(spark, str(tmp_path / "index"), 2).start()
    handle = index_handler(index, fan=3)
    runs = []

    def fails_once(batch, batch_id):
        handle(batch, batch_id)
        runs.append(batch_id)
        if len(runs) == 1:
            raise RuntimeError("lost")

    folder = tmp_path / "pages"
    folder.mkdir()
    pages = [
        [("u", "<p>old cat</p>", 1), ("u", "<p>new cat</p>", 2), ("v", "<p>a dog</p>", 1)],
        [("u", None, 3), ("w", "<b>cat sat</b>", 3)],
        [("v", "<p>the dog</p>", 4), ("x", "", 4)],
    ]
    schema = "url string, html string, ts bigint"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        each_batch(stream, fails_once, str(tmp_path / "checkpoint"), every=None).awaitTermination()

    for k, rows in enumerate(pages):
        lines = [json.dumps({"url": u, "html": h, "ts": t}) for u, h, t in rows]
        (folder / f"{k}.json").write_text("\n".join(lines))
        if k == 0:
            with pytest.raises(Exception, match="lost"):
                run()
        run()
    assert runs == [0, 0, 1, 2]
    assert {r.url: r.n_tokens for r in index.documents().collect()} == {"v": 2, "w": 2, "x": 0}
    assert [u for u, _ in hits(index.search("cat", 5))] == ["w"]
    # An unfinished version is passed over.
    version, segments = index.manifest()
    (tmp_path / "index" / "manifest" / f"version={version + 1}").mkdir()
    assert index.manifest() == (version, segments)
    index.append(spark.createDataFrame([("y", "cat")], "url string, content string"), batch=9)
    assert index.manifest()[0] == version + 1
