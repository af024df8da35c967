"""Sign-up, login, tokens, requests and tasks, hand-written and against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webtrawl.operators import accounts, replies, requests, tasks
from webtrawl.plans import accounts as plans
from webtrawl.plans import tasks as task_plans
from webtrawl.schemas import USERS

NOW = datetime(2024, 1, 1, 10)
DAY = timedelta(days=1)
EMAIL, NAME = accounts.EMAIL_TAKEN, accounts.NAME_TAKEN


def one_by_one(signups, emails, names):
    emails, names, out = set(emails), set(names), {}
    for seq, email, name in sorted(signups):
        if email in emails:
            out[seq] = EMAIL
        elif name in names:
            out[seq] = NAME
        else:
            out[seq] = "ok"
            emails.add(email)
            names.add(name)
    return out


def users_of(spark, pairs):
    rows = [(i, e, n, NOW, NOW) for i, (e, n) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, USERS.schema)


@pytest.mark.parametrize("seed", range(6))
def test_signup_batch(spark, seed):
    rng = random.Random(seed)
    # One email holds a third of all signups.
    signups = [
        (i, "hot" if rng.random() < 0.33 else f"e{rng.randrange(12)}", f"n{rng.randrange(12)}")
        for i in rng.sample(range(1000), 80)
    ]
    known = [("e1", "n1"), ("e2", "other")]
    df = spark.createDataFrame(signups, "seq bigint, email string, name string")
    got = {r.seq: r.status for r in plans.signup_batch(df, users_of(spark, known)).collect()}
    assert got == one_by_one(signups, [e for e, _ in known], [n for _, n in known])


def test_signup_chain(spark):
    """Each signup meets the one before: the longest possible chain of decisions."""
    signups = [(i, f"e{(i + 1) // 2}", f"n{i // 2}") for i in range(9)]
    df = spark.createDataFrame(signups, "seq bigint, email string, name string")
    got = {r.seq: r.status for r in plans.signup_batch(df, users_of(spark, [])).collect()}
    assert got == one_by_one(signups, [], [])


@pytest.mark.parametrize("part_rows", [200_000, 40])
def test_long_chains_end_in_few_jobs(spark, part_rows):
    """Chains of thousands of conflicts are settled part by part, in a bounded number of jobs."""
    length = 10_000 if part_rows > 1_000 else 44
    chain = [(i, f"e{(i + 1) // 2}", f"n{i // 2}") for i in range(length)]
    apart = [(20_000 + k, f"x{k % 50}", f"y{k % 70}") for k in range(300)]
    df = spark.createDataFrame(chain + apart, "seq bigint, email string, name string")
    spark.sparkContext.setJobGroup(f"signups {part_rows}", "chain")
    got = {r.seq for r in plans.accept_signups(df, rounds=2, part_rows=part_rows).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"signups {part_rows}")
    spark.sparkContext._jsc.clearJobGroup()
    assert got == {seq for seq, status in one_by_one(chain + apart, [], []).items() if status == "ok"}
    assert part_rows < 1_000 or len(jobs) < 400


def test_signup_with_missing_fields(spark):
    rows = [(1, None, "n"), (2, "e", None), (3, None, None), (4, "e", "n")]
    df = spark.createDataFrame(rows, "seq bigint, email string, name string")
    got = {r.seq: r.status for r in plans.signup_batch(df, users_of(spark, [])).collect()}
    assert got == {1: "email required", 2: "name required", 3: "email required", 4: "ok"}


def test_login_batch(spark):
    users = users_of(spark, [("a", "A"), ("b", "B")])
    rows = [(1, "a", NOW, "t1"), (2, "a", NOW + timedelta(seconds=5.5), "t2"), (3, "z", NOW, "t3")]
    logins = spark.createDataFrame(rows, "event_id int, email string, issued timestamp_ntz, token string")
    outcome = plans.login_batch(logins, users)
    got = {r.email: (r.status, r.token, r.logins, r.expire_date) for r in outcome.collect()}
    assert got == {
        "a": ("ok", "t2", 2, NOW + timedelta(seconds=5) + DAY),
        "z": ("Unregistered user", None, 1, None),
    }
    dates = {r.email: r.last_login_date for r in plans.apply_logins(users, outcome).collect()}
    assert dates == {"a": NOW + timedelta(seconds=5), "b": NOW}


def test_token_expiry_is_strict(spark):
    users = users_of(spark, [("a", "A")])
    tokens = spark.createDataFrame([("t", 1, NOW), ("ghost", 99, NOW)], "token string, user_id int, expire_date timestamp_ntz")
    rows = [
        (1, "t", NOW),
        (2, "t", NOW + timedelta(milliseconds=999)),
        (3, "t", NOW + timedelta(seconds=1)),
        (4, "nope", NOW),
        (5, None, NOW),
        (6, "ghost", NOW),
    ]
    asked = spark.createDataFrame(rows, "request_id int, token string, ts timestamp_ntz")
    got = {r.request_id: r.status for r in accounts.validate_tokens(asked, tokens, users).collect()}
    assert got == {1: "ok", 2: "ok", 3: "Token expired", 4: "Invalid token", 5: "Invalid token", 6: "unknown user"}
    got = {r.request_id: (r.status, r.author_id) for r in accounts.authorize(asked, tokens, users).collect()}
    assert got[5] == ("forbidden", None)
    assert got[1] == ("ok", 1)


def test_token_validity(spark):
    logins = [(1, 1, NOW, "t1"), (1, 2, NOW + timedelta(hours=3), "t2")]
    logins = spark.createDataFrame(logins, "user_id int, event_id int, issued timestamp_ntz, token string")
    rows = [
        (1, "t1", NOW - timedelta(seconds=1)),
        (2, "t1", NOW),
        (3, "t1", NOW + timedelta(hours=3)),
        (4, "t2", NOW + timedelta(hours=3)),
        (5, "t2", NOW + timedelta(hours=27)),
        (6, "t2", NOW + timedelta(hours=27, seconds=1)),
    ]
    asked = spark.createDataFrame(rows, "request_id int, token string, ts timestamp_ntz")
    validity = accounts.token_validity(asked, accounts.token_lifetimes(logins))
    got = {r.request_id: r.status for r in validity.collect()}
    bad, good = "Invalid token", "ok"
    assert got == {1: bad, 2: good, 3: bad, 4: good, 5: good, 6: "Token expired"}
    assert [r.token for r in accounts.latest_token(logins).collect()] == ["t2"]


RANGE, INTEGER = requests.LIMIT_RANGE, requests.NOT_INTEGER
SEARCHES = [
    (("q", "10", "0"), ("ok", 10, 0)),
    ((None, None, None), ("q required", None, None)),
    (("q", None, None), ("limit required", None, None)),
    (("q", "10", None), ("offset required", None, None)),
    (("q", "0", "0"), (RANGE, None, None)),
    (("q", "1", "-1"), ("ok", 1, 0)),
    (("q", "100", "5"), ("ok", 100, 5)),
    (("q", "101", "5"), (RANGE, None, None)),
    (("q", "x", "y"), (INTEGER + "'x'", None, None)),
    (("q", "12.5", "0"), (INTEGER + "'12.5'", None, None)),
    (("q", "1_0", "0"), (INTEGER + "'1_0'", None, None)),
    (("q", "", "0"), (INTEGER + "''", None, None)),
    (("q", " 12 ", "+5"), ("ok", 12, 5)),
    (("q", "5", "x"), (INTEGER + "'x'", None, None)),
    (("q", "9" * 60, "0"), (RANGE, None, None)),
    (("q", "5", "9" * 60), ("ok", 5, 2**63 - 1)),
    (("q", "5", "-" + "9" * 60), ("ok", 5, 0)),
    (("", "5", "0"), ("ok", 5, 0)),
]


def test_search_requests(spark):
    rows = [(i, *r) for i, (r, _) in enumerate(SEARCHES)]
    df = spark.createDataFrame(rows, "request_id int, q string, limit string, offset string")
    got = {r.request_id: (r.status, r["size"], r.start) for r in requests.search_requests(df).collect()}
    assert got == {i: e for i, (_, e) in enumerate(SEARCHES)}
    good, bad = requests.split_by_status(requests.search_requests(df))
    assert good.count() + bad.count() == len(SEARCHES)


def test_request_checks_name_the_first_fault(spark):
    rows = [(1, None, None, None), (2, "e", None, None), (3, "e", "p", None), (4, "e", "p", "n")]
    df = spark.createDataFrame(rows, "i int, email string, password string, name string")
    got = df.select("i", requests.signup_status().alias("s"), requests.login_status().alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [
        ("email required", "email required"),
        ("password required", "password required"),
        ("name required", "ok"),
        ("ok", "ok"),
    ]
    df = spark.createDataFrame([(None, None), (None, "t"), ("d", None), ("d", "t")], "domain string, token string")
    got = [r.s for r in df.select(requests.index_status().alias("s")).collect()]
    assert got == ["domain required", "domain required", "forbidden", "ok"]


def test_envelope(spark):
    df = spark.createDataFrame([(None, 1), ("bad", 2)], "status string, x int")
    got = df.select(requests.envelope(F.col("status"), F.struct("x")).alias("e")).collect()
    assert [(r.e.status, r.e.data and r.e.data.x) for r in got] == [("ok", 1), ("bad", None)]


STATS = "domain string, status string, author_id int, https int, time timestamp_ntz, pages_count int"


def test_route_tasks(spark):
    fresh, edge = NOW - timedelta(hours=1), NOW - timedelta(seconds=86_399)
    old = edge - timedelta(seconds=1)
    stats = spark.createDataFrame(
        [
            ("https://fresh", "Done", 1, 1, fresh, 20),
            ("https://fresh", "Done", 2, 1, old, 20),
            ("https://edge", "Done", 1, 1, edge, 5),
            ("https://old", "Done", 1, 1, old, 5),
        ],
        STATS,
    )
    rows = [
        (1, "https://fresh", 1, NOW),
        (2, "https://fresh", 3, NOW),
        (3, "https://fresh", 3, NOW),
        (4, "https://edge", 1, NOW),
        (5, "https://old", 2, NOW),
        (6, "https://old", 1, NOW),
        (7, "http://new", 5, NOW),
        (8, "bare", 5, NOW),
        (9, "bare", 6, NOW),
        (10, "https://fresh", 2, NOW),
    ]
    asked = spark.createDataFrame(rows, "task_id int, domain string, author_id int, ts timestamp_ntz")
    as_of = F.lit(str(NOW)).cast("timestamp_ntz")
    got = {r.task_id: (r.action, r.status, r.https, r.tasks) for r in tasks.route_tasks(asked, stats, as_of).collect()}
    assert got == {
        1: ("skip", None, None, 1),
        2: ("copy", "Done", 1, 2),
        4: ("skip", None, None, 1),
        5: ("crawl", "Crawling", 1, 1),
        6: ("copy", "Crawling", 1, 1),
        7: ("crawl", "Crawling", 0, 1),
        8: ("error", tasks.NO_PROTOCOL, 0, 1),
        9: ("copy", tasks.NO_PROTOCOL, 0, 1),
        10: ("skip", None, None, 1),
    }
    after = task_plans.apply_tasks(asked, stats, as_of)
    assert after.count() == after.select("domain", "author_id").distinct().count() == 4 + 5


def test_match_replies(spark):
    asked = spark.createDataFrame([("a", NOW), ("b", NOW), ("c", NOW)], "correlation_id string, ts timestamp_ntz")
    late = [("a", NOW + timedelta(seconds=5), "x"), ("a", NOW + timedelta(seconds=1), "first")]
    late.append(("b", NOW + timedelta(seconds=5.000001), "late"))
    answered = spark.createDataFrame(late, "correlation_id string, ts timestamp_ntz, body string")
    got = {r.correlation_id: (r.reply, r.status) for r in replies.match_replies(asked, answered).collect()}
    assert got == {"a": ("first", "ok"), "b": (None, "Timeout exceeded"), "c": (None, "Timeout exceeded")}
