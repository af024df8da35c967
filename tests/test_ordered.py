"""Ordered work in groups larger than a task, against plain windows and plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webtrawl.operators import ordered, pacing, stats
from webtrawl.operators.accounts import token_lifetimes

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    """One root holds a third of the rows; instants repeat."""
    rng = random.Random(7)
    rows = [
        (i, "hot" if rng.random() < 0.34 else f"r{rng.randrange(9)}", START + timedelta(seconds=rng.randrange(400)))
        for i in range(900)
    ]
    rows.append((900, None, START))
    return spark.createDataFrame(rows, "event_id bigint, root string, ts timestamp_ntz").repartition(5)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_rank_rows(log):
    assert ordered.has_large_group(log, ["root"], 50)
    small = ordered.rank_rows(log, ["root"], ["ts", "event_id"], "n")
    large = ordered.rank_rows(log, ["root"], ["ts", "event_id"], "n", task_rows=50)
    assert rows_of(small) == rows_of(large)


def test_rank_rows_descending(log):
    order = [F.desc("ts"), F.asc("event_id")]
    small = ordered.rank_rows(log, ["root"], order, "n")
    large = ordered.rank_rows(log, ["root"], order, "n", task_rows=50)
    assert rows_of(small) == rows_of(large)


def test_next_value(log):
    small = ordered.next_value(log, ["root"], ["ts", "event_id"], "event_id", "following")
    large = ordered.next_value(log, ["root"], ["ts", "event_id"], "event_id", "following", task_rows=50)
    assert rows_of(small) == rows_of(large)


def test_number_rows(log):
    numbered = ordered.number_rows(log, ["ts", "event_id"], "id", after=10).orderBy("ts", "event_id")
    assert [r.id for r in numbered.collect()] == list(range(11, 912))


def test_progress_and_lifetimes_take_the_large_path(log):
    order = ["ts", "event_id"]
    assert rows_of(stats.progress(log, order)) == rows_of(stats.progress(log, order, task_rows=50))
    logins = log.select(
        F.col("root").alias("user_id"), "event_id", F.col("ts").alias("issued"), F.lit("t").alias("token")
    )
    assert rows_of(token_lifetimes(logins)) == rows_of(token_lifetimes(logins, task_rows=50))


def loop_schedule(arrivals, limit, w, admitted=()):
    """Step by step: arrivals in order, each after the limit-th last start plus the window."""
    starts = list(admitted)
    for t in arrivals:
        t = max([t, *starts[-1:]])
        if len(starts) >= limit:
            t = max(t, starts[-limit] + w)
        starts.append(t)
    return starts[len(admitted):]


@pytest.mark.parametrize("task_rows", [ordered.TASK_ROWS, 40])
@pytest.mark.parametrize("limit,window", [(3, 1), (1, 5), (4, 10)])
def test_schedule_is_the_step_by_step_one(log, task_rows, limit, window):
    w = timedelta(seconds=window, microseconds=1)
    known = log.where(F.col("root").isNotNull())
    got = pacing.paced_schedule(known, "event_id", window, limit, task_rows=task_rows).collect()
    by_root = {}
    for r in sorted(got, key=lambda r: (r.ts, r.event_id)):
        by_root.setdefault(r.root, []).append(r)
    assert len(got) == 900
    for rows in by_root.values():
        assert [r.start_ts for r in rows] == loop_schedule([r.ts for r in rows], limit, w)
        assert all(r.delay_us == (r.start_ts - r.ts) / timedelta(microseconds=1) for r in rows)


def test_schedule_passes_the_audit(log):
    known = log.where(F.col("root").isNotNull())
    planned = pacing.paced_schedule(known, "event_id", 1, 3)
    audit = pacing.rate_audit(planned.select("root", F.col("start_ts").alias("ts")), 1, 3)
    assert audit.where("over_limit").count() == 0
    assert pacing.rate_audit(known, 1, 3).where("over_limit").count() > 0


@pytest.mark.parametrize("window", [1, 3, 50])
def test_audit_counts(log, window):
    rows = log.collect()
    got = {r.event_id: r.in_window for r in pacing.rate_audit(log, window).collect()}
    for r in rows:
        expected = sum(
            1 for s in rows if s.root == r.root and r.ts - timedelta(seconds=window) <= s.ts <= r.ts
        )
        assert got[r.event_id] == expected
    assert len(got) == len(rows)


def test_schedule_in_batches(spark, log):
    """Batch after batch with the kept state: the same as one loop, late rows included."""
    known = sorted(log.where("root = 'hot'").collect(), key=lambda r: r.event_id)
    w = timedelta(seconds=2, microseconds=1)
    starts, admitted = [], None
    for at in range(0, len(known), 100):
        part = spark.createDataFrame(known[at : at + 100], log.schema)
        planned = pacing.paced_schedule(part, "event_id", 2, 3, admitted=admitted)
        rows = sorted(planned.collect(), key=lambda r: (max([r.ts, *starts[-1:]]), r.ts, r.event_id))
        assert [r.start_ts for r in rows] == loop_schedule([r.ts for r in rows], 3, w, starts)
        starts += [r.start_ts for r in rows]
        state = pacing.last_admitted(planned, admitted, 3).collect()
        admitted = spark.createDataFrame(state, "root string, slot int, at bigint")
    assert len(starts) == len(known)


def test_fair_order(spark):
    rows = [("b", 1), ("b", 2), ("a", 5), ("b", 3), ("a", 6)]
    df = spark.createDataFrame(rows, "root string, at int")
    got = [(r.turn, r.root, r.at) for r in pacing.fair_order(df, ["at"]).collect()]
    assert got == [(1, "a", 5), (1, "b", 1), (2, "a", 6), (2, "b", 2), (3, "b", 3)]


def test_crawl_status(spark):
    frontier = spark.createDataFrame([("a", "a/1"), ("a", "a/2"), ("b", "b/1")], "root string, url string")
    fetched = spark.createDataFrame([("a", "a/1"), ("b", "b/1"), ("b", "b/1")], "root string, url string")
    got = {r.root: (r.pages_count, r.pending, r.status) for r in stats.crawl_status(frontier, fetched).collect()}
    assert got == {"a": (1, 1, "Crawling"), "b": (1, 0, "Done")}
