"""Streams over JSON files: equal to the batch result, and once only after a restart."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.operators import pacing, replies
from webtrawl.schemas import USERS
from webtrawl.sources import messages
from webtrawl.sources.changes import ChangeTable
from webtrawl.streaming import accounts as account_stream
from webtrawl.streaming import pacing as pacing_stream
from webtrawl.streaming import replies as reply_stream
from webtrawl.streaming import tasks as task_stream
from webtrawl.streaming.run import each_batch, publish

NOW = datetime(2024, 1, 1, 10)


def put(folder, name, rows):
    """One input file of JSON lines."""
    folder.mkdir(exist_ok=True)
    staged = folder.parent / f"{folder.name}-{name}"
    staged.write_text("\n".join(json.dumps(r) for r in rows))
    staged.replace(folder / f"{name}.json")


def message(id_, body, at=NOW):
    text = body if isinstance(body, str) else json.dumps(body)
    return {"correlation_id": id_, "reply_to": "me", "ts": at.isoformat() + "Z", "body": text}


def crawl_task(id_, domain, author, at=NOW):
    return message(id_, {"type": "crawl", "data": {"domain": domain, "author_id": author}}, at)


def drain(stream, handle, checkpoint):
    each_batch(stream, handle, str(checkpoint), every=None).awaitTermination()


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


PAGES = [
    ("https://one.example", '<title>t</title><a href="a">A</a><a href="gone">G</a><p>home page</p>'),
    ("https://one.example/a", '<a href="../b#x">B</a>'),
    ("https://one.example/b", "<p>deep  page</p>"),
    ("https://two.example", "<p>two</p>"),
]


def test_parse_messages(spark, tmp_path):
    bodies = [
        '{"type": "crawl", "data": {"domain": "https://d", "author_id": 3}}',
        '{"type": "index", "index": {"domain": "python.example", "https": true}}',
        '{"type": "index", "index": {"domain": "python.example", "https": false}}',
        '{"type": "crawl", "data"',
        "",
        "nonsense",
    ]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "correlation_id string, body string")
    good, bad = messages.split_malformed(messages.parse_messages(df))
    got = {r.correlation_id: (r.domain, r.author_id) for r in good.select("correlation_id", *messages.task_fields()).collect()}
    assert got == {"0": ("https://d", 3), "1": ("https://python.example", None), "2": ("http://python.example", None)}
    assert sorted(r.correlation_id for r in bad.collect()) == ["3", "4", "5"]


def test_task_sink(spark, tmp_path):
    df = spark.createDataFrame([("https://d", 3)], "domain string, author_id int")
    for _ in range(2):
        body = messages.task_body(F.col("domain"), F.col("author_id")).alias("body")
        messages.append_json(df.select(body), str(tmp_path / "tasks"))
    stored = spark.read.json(str(tmp_path / "tasks"))
    assert [json.loads(r.body) for r in stored.collect()] == [
        {"type": "crawl", "data": {"domain": "https://d", "author_id": 3}}
    ] * 2


def test_task_stream_source(spark, inbox):
    """Malformed messages are set aside; the rest arrives whole."""
    put(inbox, "1", [crawl_task("a", "https://one.example", 1), message("b", "{cut")])
    parsed = messages.parse_messages(messages.message_stream(spark, str(inbox)))
    seen = {}

    def handle(batch, _):
        good, bad = messages.split_malformed(batch)
        seen["good"] = [r.correlation_id for r in good.collect()]
        seen["bad"] = [(r.correlation_id, r.body) for r in bad.collect()]

    drain(parsed, handle, inbox.parent / "checkpoint")
    assert seen == {"good": ["a"], "bad": [("b", "{cut")]}


def test_crawl_stream(spark, inbox, tmp_path):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    tables = task_stream.CrawlTables.below(spark, str(tmp_path / "state")).start()
    stream = messages.message_stream(spark, str(inbox))
    put(inbox, "1", [crawl_task("a", "https://one.example", 1), crawl_task("b", "bare.example", 1), message("c", "?")])
    drain(stream, task_stream.task_handler(tables, pages), tmp_path / "checkpoint")
    put(
        inbox,
        "2",
        [
            crawl_task("d", "https://one.example", 1, NOW + timedelta(hours=1)),
            crawl_task("e", "https://one.example", 2, NOW + timedelta(hours=1)),
            crawl_task("f", "https://two.example", 2, NOW + timedelta(hours=1)),
        ],
    )
    drain(stream, task_stream.task_handler(tables, pages), tmp_path / "checkpoint")
    stats = {(r.domain, r.author_id): (r.status, r.pages_count) for r in tables.stats.current().collect()}
    assert stats == {
        ("https://one.example", 1): ("Done", 3),
        ("bare.example", 1): ("Error: protocol should be specified", 0),
        ("https://one.example", 2): ("Done", 0),
        ("https://two.example", 2): ("Done", 1),
    }
    documents = {r.url: r.content for r in tables.documents.current().collect()}
    assert documents == {
        "https://one.example": "AGhome page",
        "https://one.example/a": "B",
        "https://one.example/b": "deep page",
        "https://two.example": "two",
    }
    assert [r.correlation_id for r in tables.malformed.rows().collect()] == ["c"]


def test_restart_exactly_once(spark, inbox, tmp_path):
    """A batch cut off half-way runs again under its number and leaves no duplicates."""
    pages = spark.createDataFrame(PAGES, "url string, html string")
    tables = task_stream.CrawlTables.below(spark, str(tmp_path / "state")).start()
    stream = messages.message_stream(spark, str(inbox))
    handle = task_stream.task_handler(tables, pages)
    put(inbox, "1", [crawl_task("a", "https://one.example", 1)])
    runs = []

    def fails_at_the_end(batch, batch_id):
        handle(batch, batch_id)
        runs.append(batch_id)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(stream, fails_at_the_end, tmp_path / "checkpoint")

    def counted(batch, batch_id):
        handle(batch, batch_id)
        runs.append(batch_id)

    drain(stream, counted, tmp_path / "checkpoint")
    assert runs == [0, 0]
    assert tables.stats.rows().count() == 1
    assert tables.documents.rows().count() == 3
    drain(stream, counted, tmp_path / "checkpoint")
    assert runs == [0, 0]


def test_auth_stream_dispatch(spark, inbox, tmp_path):
    known = spark.createDataFrame([(4, "old@x", "old", NOW, NOW)], USERS.schema)
    tables = account_stream.AccountTables.below(spark, str(tmp_path / "state")).start(known)
    stream = messages.message_stream(spark, str(inbox))

    def ask(id_, kind, at=NOW, **data):
        return message(id_, {"type": kind, "data": data}, at)

    put(
        inbox,
        "1",
        [
            ask("s1", "signup", email="new@x", name="new", password="p"),
            ask("s2", "signup", email="old@x", name="other", password="p"),
            ask("s3", "signup", at=NOW + timedelta(seconds=1), email="new@x", name="later", password="p"),
            ask("l1", "login", email="old@x", password="p"),
            ask("l2", "login", email="nobody@x", password="p"),
            ask("s4", "signup", name="nameless", password="p"),
            ask("s5", "signup", email="bare@x", password="p"),
            ask("l4", "login", password="p"),
            ask("l5", "login", email=None),
            ask("v0", "validate"),
            ask("u1", "dance"),
            message("m1", "{"),
        ],
    )
    drain(stream, account_stream.account_handler(tables), tmp_path / "checkpoint")
    answered = {r.correlation_id: json.loads(r.body) for r in tables.replies.rows().collect()}
    assert {k: v["status"] for k, v in answered.items()} == {
        "s1": "ok",
        "s2": "User with this email already exists",
        "s3": "User with this email already exists",
        "l1": "ok",
        "l2": "Unregistered user",
        "s4": "email required",
        "s5": "name required",
        "l4": "email required",
        "l5": "email required",
        "v0": "Invalid token",
        "u1": "unknown type",
        "m1": "unknown type",
    }
    assert answered["s1"]["data"]["expire_date"] == "2024-01-02 10:00:00"
    assert len(answered["s1"]["data"]["token"]) == 36
    assert answered["s2"]["data"] == {}

    later = NOW + timedelta(hours=5)
    put(
        inbox,
        "2",
        [
            ask("v1", "validate", later, token=answered["s1"]["data"]["token"]),
            ask("v2", "validate", later, token=answered["l1"]["data"]["token"]),
            ask("v3", "validate", later + timedelta(days=1), token=answered["s1"]["data"]["token"]),
            ask("l3", "login", later, email="old@x", password="p"),
        ],
    )
    drain(stream, account_stream.account_handler(tables), tmp_path / "checkpoint")
    answered.update({r.correlation_id: json.loads(r.body) for r in tables.replies.rows().collect()})
    assert answered["v1"] == {
        "status": "ok",
        "data": {
            "id": 5,
            "email": "new@x",
            "name": "new",
            "created_date": "2024-01-01 10:00:00",
            "last_login_date": "2024-01-01 10:00:00",
        },
    }
    # The login of the same batch replaced the token.
    assert answered["v2"]["status"] == "Invalid token"
    assert answered["v3"]["status"] == "Token expired"
    users = {r.id: (r.name, r.last_login_date) for r in tables.users.current().collect()}
    assert users == {4: ("old", later), 5: ("new", NOW)}
    assert "password" not in tables.users.current().columns


def test_auth_stream_keeps_messages_without_or_with_one_id(spark, inbox, tmp_path):
    """Only redeliveries count once; a batch that runs again writes the same."""
    known = spark.createDataFrame([(4, "old@x", "old", NOW, NOW)], USERS.schema)
    tables = account_stream.AccountTables.below(spark, str(tmp_path / "state")).start(known)

    def ask(id_, kind, **data):
        return message(id_, {"type": kind, "data": data})

    first = ask("d", "signup", email="a@x", name="a", password="p")
    again = {**first, "ts": (NOW + timedelta(seconds=3)).isoformat() + "Z"}
    put(
        inbox,
        "1",
        [
            again,
            first,
            ask("d", "signup", email="b@x", name="b", password="p"),
            ask("d", "login", email="old@x", password="p"),
            ask(None, "signup", email="c@x", name="c", password="p"),
            ask(None, "signup", email="e@x", name="e", password="p"),
            ask(None, "login", email="c@x", password="p"),
            ask(None, "validate", token="none"),
            ask(None, "validate", token="none"),
            message(None, "{"),
        ],
    )
    handle = account_stream.account_handler(tables, "s")
    written = []

    def repeated(batch, batch_id):
        for rows in (batch, batch.repartition(5)):
            handle(rows, batch_id)
            replies = tables.replies.rows().collect()
            written.append(sorted((str(r.correlation_id), r.reply_to, r.body) for r in replies))

    drain(messages.message_stream(spark, str(inbox)), repeated, tmp_path / "checkpoint")
    assert written[0] == written[1]
    found = [(i, json.loads(body)) for i, _, body in written[0]]
    assert sorted((i, b["status"]) for i, b in found) == (
        [("None", "Invalid token")] * 2 + [("None", "ok")] * 3 + [("None", "unknown type")] + [("d", "ok")] * 3
    )
    tokens = [b["data"]["token"] for _, b in found if b["status"] == "ok"]
    assert len(set(tokens)) == 6 and all(len(t) == 36 for t in tokens)
    users = {r.email: r.created_date for r in tables.users.current().collect()}
    assert users == {e: NOW for e in ("old@x", "a@x", "b@x", "c@x", "e@x")}


def test_reply_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok", 1), ("b", "Invalid token", None)], "correlation_id string, status string, id int")
    body = messages.reply_body(F.col("status"), F.struct("id")).alias("body")
    messages.append_json(df.select("correlation_id", body), str(tmp_path / "replies"))
    stored = {r.correlation_id: json.loads(r.body) for r in spark.read.json(str(tmp_path / "replies")).collect()}
    assert stored == {"a": {"status": "ok", "data": {"id": 1}}, "b": {"status": "Invalid token", "data": {}}}


def test_publish_once(spark, inbox, tmp_path):
    """Messages sent on as files, each once over restarts."""
    stream = messages.message_stream(spark, str(inbox))
    sent = stream.select("correlation_id", "reply_to", F.concat(F.lit("re:"), "body").alias("body"))
    out = str(tmp_path / "out")
    for name, ids in (("1", "ab"), ("2", "c")):
        put(inbox, name, [message(i, i * 2) for i in ids])
        publish(sent, str(tmp_path / "checkpoint"), out, every=None).awaitTermination()
    publish(sent, str(tmp_path / "checkpoint"), out, every=None).awaitTermination()
    got = sorted((r.correlation_id, r.reply_to, r.body) for r in spark.read.json(out).collect())
    assert got == [("a", "me", "re:aa"), ("b", "me", "re:bb"), ("c", "me", "re:cc")]


ARRIVAL = "event_id bigint, root string, ts timestamp"


def test_pacing_stream(spark, inbox, tmp_path):
    """Batch by batch, the stream plans what one batch over the whole log plans."""
    schema = T.StructType.fromDDL("event_id bigint, root string, ts timestamp_ntz, start_ts timestamp_ntz, delay_us bigint")
    admitted = ChangeTable(spark, str(tmp_path / "admitted"), pacing_stream.ADMITTED, ("root", "slot")).start()
    schedule = ChangeTable(spark, str(tmp_path / "schedule"), schema).start()
    rows = [(i, f"r{i % 3 % 2}", NOW + timedelta(milliseconds=130 * i)) for i in range(60)]
    stream = spark.readStream.schema(ARRIVAL).json(str(inbox))
    handle = pacing_stream.pacing_handler(admitted, schedule, "event_id", 1, 3)
    for part in range(3):
        put(
            inbox,
            str(part),
            [{"event_id": i, "root": r, "ts": t.isoformat() + "Z"} for i, r, t in rows[part * 20 : part * 20 + 20]],
        )
        drain(stream, handle, tmp_path / "checkpoint")
    log = spark.createDataFrame(rows, "event_id bigint, root string, ts timestamp_ntz")
    expected = {r.event_id: r.start_ts for r in pacing.paced_schedule(log, "event_id", 1, 3).collect()}
    got = {r.event_id: r.start_ts for r in schedule.rows().collect()}
    assert got == expected
    assert admitted.current().count() == 6


def test_seen_stream(spark, inbox, tmp_path):
    stream = spark.readStream.schema("root string, url string, ts timestamp").json(str(inbox))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = (
            task_stream.unseen_stream(stream)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()

    row = {"root": "r", "url": "u", "ts": NOW.isoformat() + "Z"}
    put(inbox, "1", [row, row, {**row, "root": "s"}])
    run()
    put(inbox, "2", [row, {**row, "url": "v"}])
    run()
    got = sorted((r.root, r.url) for r in spark.read.parquet(out).collect())
    assert got == [("r", "u"), ("r", "v"), ("s", "u")]
    assert task_stream.unseen_stream(stream, "1 hour").isStreaming


def test_seen_table(spark, inbox, tmp_path):
    schema = T.StructType.fromDDL("root string, url string")
    seen = ChangeTable(spark, str(tmp_path / "seen"), schema, ("root", "url")).start()
    stream = spark.readStream.schema(schema).json(str(inbox))
    row = {"root": "r", "url": "u"}
    for name, rows in (("1", [row, row, {**row, "root": "s"}]), ("2", [row, {**row, "url": "v"}])):
        put(inbox, name, rows)
        drain(stream, task_stream.unseen_handler(seen), tmp_path / "checkpoint")
    got = sorted((r.batch, r.root, r.url) for r in seen.rows().collect())
    assert got == [(0, "r", "u"), (0, "s", "u"), (1, "r", "v")]


def test_compacted_changes(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, name string")
    table = ChangeTable(spark, str(tmp_path / "old"), schema, ("id",)).start()
    table.write(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    table.write(spark.createDataFrame([(1, "c")], schema), 1)
    assert {r.id: r.name for r in table.current(1).collect()} == {1: "a", 2: "b"}
    small = table.compacted(str(tmp_path / "new"))
    assert sorted((r.id, r.name, r.batch) for r in small.rows().collect()) == [(1, "c", -1), (2, "b", -1)]
    small.write(spark.createDataFrame([(2, "d")], schema), 2)
    assert {r.id: r.name for r in small.current().collect()} == {1: "c", 2: "d"}


def test_page_count_stream(spark, inbox, tmp_path):
    put(inbox, "1", [{"root": "a"}, {"root": "a"}, {"root": "b"}])
    put(inbox, "2", [{"root": "a"}])
    stream = spark.readStream.schema("root string").option("maxFilesPerTrigger", 1).json(str(inbox))
    latest = {}
    query = (
        task_stream.page_counts_stream(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, _: latest.update({r.root: r.pages_count for r in df.collect()}))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert latest == {"a": 3, "b": 1}


def test_paced_stream_is_the_schedule_of_the_whole_log(spark, tmp_path):
    """Out of order within the lateness, over restarts; the state keeps the last starts only."""
    draw = random.Random(2)
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    roots = ["hot", "hot", "hot", "a", "b", None]
    rows = [(draw.choice(roots), draw.randrange(40) / 2, k) for k in range(150)]
    rows.sort(key=lambda r: r[1] + draw.random() * 8)

    def run():
        stream = spark.readStream.schema("root string, ts timestamp, event_id bigint").option(
            "maxFilesPerTrigger", 1
        ).json(str(folder))
        query = (
            pacing_stream.paced_stream(stream, "event_id", window_seconds=2)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(checkpoint))
            .trigger(availableNow=True)
            .start(str(out))
        )
        query.awaitTermination()

    def line(root, seconds, k):
        return {"root": root, "ts": (NOW + timedelta(seconds=seconds)).isoformat() + "Z", "event_id": k}

    for k in range(3):
        put(folder, str(k), [line(*r) for r in rows[50 * k : 50 * (k + 1)]])
        run()
    put(folder, "last", [line("end", 1_000, -1)])
    run()
    held = spark.read.format("statestore").option("stateVarName", "starts").load(str(checkpoint))
    kept = {r["root"]: r["n"] for r in held.groupBy("key.root").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(kept.values()) <= pacing.MAX_FETCHES
    log = spark.createDataFrame(
        [(r, NOW + timedelta(seconds=t), k) for r, t, k in rows], "root string, ts timestamp_ntz, event_id bigint"
    )
    wanted = pacing.paced_schedule(log, "event_id", window_seconds=2).select("root", "event_id", "start_ts", "delay_us")
    got = spark.read.parquet(str(out)).where("root <=> NULL OR root <> 'end'").select("root", "event_id", "start_ts", "delay_us")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, wanted.collect())))


def rpc_row(id_, seconds, body):
    at = NOW + timedelta(seconds=seconds)
    return {"correlation_id": id_, "ts": at.isoformat() + "Z", "body": body}


def match_from(spark, requests, answers, out, checkpoint):
    """Everything there is, a file a batch, and what has come out so far."""

    def read(folder):
        schema = "correlation_id string, ts timestamp, body string"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    query = (
        reply_stream.match_replies_stream(read(requests), read(answers))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(checkpoint))
        .trigger(availableNow=True)
        .start(str(out))
    )
    query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(out)).collect()]


def test_rpc_join_stream(spark, tmp_path):
    """One row a request: a second reply in time gives none, and a restart none either."""
    requests, answers = tmp_path / "requests", tmp_path / "replies"
    put(requests, "1", [rpc_row("a", 0, "q"), rpc_row("b", 0, "q"), rpc_row("c", 0, "q"), rpc_row("a", 0, "q")])
    put(answers, "1", [rpc_row("a", 5, "second"), rpc_row("b", 6, "late"), rpc_row("a", 4, "first")])
    match_from(spark, requests, answers, tmp_path / "out", tmp_path / "checkpoint")
    # The state outlives the stream; later traffic moves both watermarks past the deadlines.
    put(requests, "2", [rpc_row("z", 1000, "q")])
    put(answers, "2", [rpc_row("y", 1000, "other"), rpc_row("c", 1, "too late to be taken")])
    got = match_from(spark, requests, answers, tmp_path / "out", tmp_path / "checkpoint")
    rows = sorted((r[0], r[3], r[4]) for r in got)
    assert rows[:2] == [("a", "first", "ok")] * 2
    assert ("b", None, "Timeout exceeded") in rows
    assert len(rows) == 4


def test_rpc_stream_is_the_batch_form(spark, tmp_path):
    """Whatever the order of arrival, and with an id that has a third of all messages."""
    draw = random.Random(11)
    asked = [(draw.choice(["hot", f"id{k % 9}", None]), draw.randrange(60)) for k in range(60)]
    answers = [(draw.choice(["hot", f"id{k % 9}", None]), draw.randrange(60), draw.choice("xyz")) for k in range(70)]
    folders = tmp_path / "requests", tmp_path / "replies"
    for folder, rows in zip(folders, ([(*r, "q") for r in asked], answers), strict=True):
        draw.shuffle(rows)
        for k in range(3):
            put(folder, str(k), [rpc_row(*r) for r in rows[k::3]])
        put(folder, "9", [rpc_row("end", 100_000, "")])

    def read(folder):
        schema = "correlation_id string, ts timestamp, body string"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    query = (
        reply_stream.match_replies_stream(*map(read, folders), late="10 minutes")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("correlation_id <=> NULL OR correlation_id != 'end'").collect()]
    tables = [spark.read.schema("correlation_id string, ts timestamp, body string").json(str(f)) for f in folders]
    wanted = replies.match_replies(*tables).where("correlation_id <=> NULL OR correlation_id != 'end'")
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in wanted.collect())
    assert len(got) == 60


def test_expired_tokens_leave_the_state(spark, tmp_path):
    """Tokens come, go and expire in event time; what the state holds is read back."""
    known = spark.createDataFrame([("old", NOW), ("long", NOW + timedelta(days=9))], "token string, expire_date timestamp_ntz")
    asked, issued = tmp_path / "asked", tmp_path / "issued"

    def ask(id_, token, seconds):
        return {"request_id": id_, "token": token, "ts": (NOW + timedelta(seconds=seconds)).isoformat() + "Z"}

    def issue(token, seconds, until):
        expire = None if until is None else (NOW + timedelta(seconds=until)).isoformat()
        return {"token": token, "expire_date": expire, "ts": (NOW + timedelta(seconds=seconds)).isoformat() + "Z"}

    def run():
        def read(folder, schema):
            return spark.readStream.schema(schema).json(str(folder))

        query = (
            reply_stream.validate_tokens_state(
                read(asked, "request_id string, token string, ts timestamp"),
                read(issued, "token string, expire_date timestamp_ntz, ts timestamp"),
                known, keep=100,
            )
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "expiry").load(str(tmp_path / "checkpoint"))
        held = {r.token for r in state.select("key.token").collect()}
        return {r.request_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}, held

    put(asked, "1", [ask("1", "old", 0), ask("2", "old", 1), ask("3", "new", 4), ask("4", "new", 6), ask("5", "gone", 8)])
    put(issued, "1", [issue("new", 5, 50), issue("gone", 2, 90), issue("gone", 7, None)])
    got, held = run()
    assert got == {"1": "ok", "2": "Token expired", "3": "Invalid token", "4": "ok", "5": "Invalid token"}
    assert held == {"old", "long", "new"}
    # The stream starts again where it was; then the watermark passes two expiries.
    put(asked, "2", [ask("6", "new", 51), ask("7", "long", 51), ask("8", "long", 400), ask("9", None, 400)])
    put(issued, "2", [issue("late", 400, 9_000)])
    run()
    put(asked, "3", [ask("10", "old", 500), ask("11", "late", 500)])
    put(issued, "3", [issue("more", 500, 9_000)])
    got, held = run()
    assert [got[k] for k in ("6", "7", "8")] == ["Token expired", "ok", "ok"]
    assert got["10"] == "Invalid token" and got["11"] == "ok"
    assert held == {"long", "late", "more"}


def test_token_ttl_stream(spark, inbox, tmp_path):
    tokens = spark.createDataFrame([("t", NOW)], "token string, expire_date timestamp_ntz")

    def row(id_, token, at):
        return {"request_id": id_, "token": token, "ts": at.isoformat() + "Z"}

    put(inbox, "1", [row(1, "t", NOW), row(2, "t", NOW + timedelta(seconds=1)), row(3, "x", NOW)])
    stream = spark.readStream.schema("request_id int, token string, ts timestamp").json(str(inbox))
    got = {}
    query = (
        reply_stream.validate_tokens_stream(stream, tokens)
        .writeStream.foreachBatch(lambda df, _: got.update({r.request_id: r.status for r in df.collect()}))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert got == {1: "ok", 2: "Token expired", 3: "Invalid token"}
