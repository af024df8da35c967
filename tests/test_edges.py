"""Rows that must not be lost, and values that must not stop a job."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.functions import html
from webtrawl.operators import pacing, replies, requests, search, tables, tasks
from webtrawl.plans import index
from webtrawl.schemas import USERS
from webtrawl.sources import changes, pages

NOON = dt.datetime(2024, 1, 31, 12)
HOUR = dt.timedelta(hours=1)


def at(seconds):
    return NOON + dt.timedelta(seconds=seconds)


# Character references


@pytest.mark.parametrize(
    "page, text",
    [
        ("caf&eacute; &#38; &#x41; &copy;", "café &amp; A ©"),
        ("&lt;b&gt; &amp;lt; AT&T &bogus; &copyright &copy x", "&lt;b&gt; &amp;lt; AT&amp;T &amp;bogus &amp;copyright © x"),
        ("&#xD800; &#128; &#x110000; &#0; &#99999999999999999999; &#x1F600;", "� € � � � 😀"),
        ("<p>a&notin;b</p>&hellip;<i title='&eacute;'>x</i>", "a∉b…x"),
        ("no references", "no references"),
        ("&", "&amp;"),
        (None, None),
    ],
)
def test_references_in_text(spark, page, text):
    row = spark.createDataFrame([(page,)], "html string").select(
        html.page_text(F.col("html"), decode=True).alias("native"), html.parse_html("html")["content"].alias("parsed")
    ).first()
    assert row.native == row.parsed == text


def test_references_in_hrefs(spark):
    page = '<a href="/q?a=1&#38;b=2&amp;c&eacute;&lt=3&copy=4&copy">x</a>'
    got = spark.createDataFrame([(page,)], "html string").select(html.page_hrefs(F.col("html"))).first()[0]
    assert got == ["/q?a=1&b=2&cé&lt=3&copy=4©"]


def test_a_page_the_parser_refuses_is_a_row(spark):
    rows = [("<![bad[x]]>",), ("<p>good &#xD800;</p>",)]
    got = spark.createDataFrame(rows, "html string").select(html.parse_html("html").alias("p")).collect()
    assert got[0].p.content is None and got[0].p.error
    assert got[1].p.content == "good �" and got[1].p.error is None


def test_index_text_is_decoded(spark):
    docs = index.documents_of(spark.createDataFrame([("u", "<p>caf&eacute;&nbsp;x</p>")], "url string, html string"))
    assert docs.first().content == "café x"


# Versions, searches, columns


def test_equal_versions_leave_one_row(spark):
    rows = [("u1", "of the", 3), ("u1", "of the", 3), ("u1", "old", 2), ("u2", "b", 1), ("u2", "a", 1), ("u3", "c", 1)]
    newest = pages.newest_versions(spark.createDataFrame(rows, "url string, html string, v int"), "v")
    assert sorted(map(tuple, newest.collect())) == [("u1", "of the", 3), ("u2", "b", 1), ("u3", "c", 1)]


def test_a_huge_offset_is_an_empty_page(spark):
    asked = [("1", "x", "10", "0"), ("2", "x", "10", "9" * 25), ("3", "x", "100", str((1 << 63) - 1))]
    checked = requests.search_requests(spark.createDataFrame(asked, "request_id string, q string, limit string, offset string"))
    docs = search.tokenise(spark.createDataFrame([("u", "x y")], "url string, content string"))
    accepted, refused = requests.split_by_status(checked)
    assert refused.isEmpty()
    assert [r.request_id for r in search.search_requests(docs, accepted).collect()] == ["1"]


def test_a_bad_number_refuses_its_row(spark):
    rows = [("1", "a@x", "a"), ("abc", "b@x", "b"), (None, "c@x", "c")]
    frame = spark.createDataFrame(rows, "id string, email string, name string").withColumns(
        {"created_date": F.lit("2024-01-01 00:00:00"), "last_login_date": F.lit("no date")}
    )
    got = {r.email: r.violation for r in tables.validate(frame, USERS).collect()}
    assert got["b@x"] == "id: not a number"
    assert got["a@x"] == "last_login_date: not of its type"


# Replies


def test_a_reply_from_before_its_request_is_none(spark):
    asked = spark.createDataFrame([("a", NOON, "q"), ("b", NOON, "q")], "correlation_id string, ts timestamp_ntz, body string")
    answers = [("a", at(-9), "early"), ("a", at(2), "good"), ("a", at(3), "second"), ("b", at(-1), "early"), ("b", at(6), "late")]
    got = replies.match_replies(asked, spark.createDataFrame(answers, "correlation_id string, ts timestamp_ntz, body string"))
    assert {r.correlation_id: (r.reply, r.status) for r in got.collect()} == {
        "a": ("good", "ok"),
        "b": (None, replies.TIMEOUT),
    }


def test_replies_are_merged_without_pairs(spark):
    """One id has a third of both sides; repeated requests and ties keep their rows."""
    draw = random.Random(5)
    asked, answers = [], []
    for k in range(300):
        asked.append(("hot" if k % 3 == 0 else f"id{k % 20}", at(draw.randrange(40)), "q"))
        answers.append(("hot" if k % 3 == 1 else f"id{k % 20}", at(draw.randrange(40)), draw.choice(["x", "y", None])))
    asked += [("hot", at(3), "q")] * 3 + [(None, at(0), "q"), (None, at(0), "q"), ("id1", None, "q")]
    answers += [(None, at(1), "z"), ("id1", None, "z")]
    schema = "correlation_id string, ts timestamp_ntz, body string"
    wanted = []
    for name, when, _ in asked:
        mine = [
            (t, b is not None, b or "") for i, t, b in answers
            if i is not None and i == name and None not in (t, when) and when <= t <= when + dt.timedelta(seconds=5)
        ]
        first = min(mine, default=None)
        body = first[2] if first and first[1] else None
        wanted.append((name, when, first and first[0], body, "ok" if first else replies.TIMEOUT))
    sides = [spark.createDataFrame(rows, schema) for rows in (asked, answers)]
    for task_rows in (1_000_000, 50):
        found = replies.match_replies(*sides, task_rows=task_rows)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString() or task_rows == 50


# Tasks


TASKS = "task_id string, domain string, author_id int, ts timestamp_ntz"
STATS = "domain string, status string, author_id int, https int, time timestamp_ntz, pages_count int, crawled_at timestamp_ntz"


def test_tasks_without_domain_or_author_stay(spark):
    asked = [("1", "https://a", None, NOON), ("2", None, 5, NOON), ("3", None, None, NOON), ("4", "https://a", 7, at(1)), ("5", "https://a", None, at(2))]
    got = tasks.route_tasks(spark.createDataFrame(asked, TASKS), spark.createDataFrame([], STATS), F.lit(NOON))
    assert {(r.domain, r.author_id): (r.action, r.status, r.tasks) for r in got.collect()} == {
        ("https://a", None): ("crawl", tasks.CRAWLING, 2),
        ("https://a", 7): ("copy", tasks.CRAWLING, 1),
        (None, 5): ("error", tasks.NO_PROTOCOL, 1),
        (None, None): ("copy", tasks.NO_PROTOCOL, 1),
    }


def test_copies_do_not_keep_a_domain_fresh(spark):
    """A new author every 23 hours: the domain is crawled again after a day all the same."""
    stats = spark.createDataFrame([("https://a", "Done", 1, 1, NOON, 12, NOON)], STATS)
    when, actions = NOON, []
    for author in range(2, 5):
        when += 23 * HOUR
        asked = spark.createDataFrame([(str(author), "https://a", author, when)], TASKS)
        row = tasks.route_tasks(asked, stats, F.lit(when)).first()
        actions.append(row.action)
        new = spark.createDataFrame([("https://a", row.status, author, 1, when, 0, row.crawled_at or when)], STATS)
        stats = stats.unionByName(new)
    assert actions == ["copy", "crawl", "copy"]


# Rates


def test_rate_audit_counts_every_window(spark):
    times = [0, 0, 1, 1, 1, 2, 5, 64, 64, 65, 127, 128, 129, 192]
    rows = [(k, "r" if k % 3 else "s", at(t)) for k, t in enumerate(times * 2)]
    fetches = spark.createDataFrame(rows, "k int, root string, ts timestamp_ntz")
    want = {
        (k, sum(r == root and ts - dt.timedelta(seconds=1) <= t <= ts for _, r, t in rows)) for k, root, ts in rows
    }
    assert {(r.k, r.in_window) for r in pacing.rate_audit(fetches).collect()} == want


def test_rate_audit_is_linear(spark):
    """All fetches of one root in one window: the plan has no sliding frame."""
    fetches = spark.range(60_000).select(F.lit("r").alias("root"), (F.lit(NOON) + F.make_dt_interval(secs=(F.col("id") % 1000) / 1000)).alias("ts"))
    got = pacing.rate_audit(fetches)
    assert got.agg(F.max("in_window")).first()[0] == 60_000
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding" in got._jdf.queryExecution().optimizedPlan().toString()




# State


def test_snapshots_bound_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "SNAPSHOT_BATCHES", 4)
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.IntegerType())])
    table = changes.ChangeTable(spark, str(tmp_path / "t"), schema, ("k",)).start()
    state = {}
    for batch in range(14):
        table.snapshot_if_due(batch)
        assert {r.k: r.v for r in table.current(batch).collect()} == state
        rows = [(batch % 5, batch), (100 + batch, batch)]
        table.write(spark.createDataFrame(rows, schema).coalesce(1), batch)
        table.write(spark.createDataFrame(rows, schema).coalesce(1), batch)  # a batch that runs again
        state.update(dict(rows))
    assert {r.k: r.v for r in table.current().collect()} == state
    since = table._since_snapshot(13)
    read = {r[0].rsplit("/", 2)[1] for r in since.select(F.input_file_name()).distinct().collect()}
    assert read == {"before=12", "batch=12"}
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(b") == 2  # other folders are not opened
