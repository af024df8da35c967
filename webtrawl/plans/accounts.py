"""Batch signup and login."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.times import expiry, to_second
from webtrawl.operators.accounts import EMAIL_TAKEN, NAME_TAKEN, OK, UNREGISTERED
from webtrawl.operators.components import components
from webtrawl.operators.ordered import rank_rows
from webtrawl.operators.requests import required
from webtrawl.sources.scratch import materialize


def _first_of_both(open_rows: DataFrame) -> DataFrame:
    """Rows that are the earliest of their email and of their name.

    Both sides are cut to one row for each value before they are joined, on the
    unique ``seq``.
    """
    by_email = open_rows.groupBy("email").agg(F.min_by(F.struct("seq", "name"), "seq").alias("r"))
    by_name = open_rows.groupBy("name").agg(F.min("seq").alias("seq")).select("seq")
    return by_email.select("r.seq", "email", "r.name").join(by_name, "seq", "left_semi")


# Rounds before the undecided rows are taken apart, and rows of a part that a task settles.
ROUNDS = 4
PART_ROWS = 200_000


def _in_order(rows: pa.Table) -> pa.Table:
    """The rows of one part accepted when taken one by one."""
    rows = rows.sort_by("_rank")
    emails: set[str] = set()
    names: set[str] = set()
    stays = []
    for email, name in zip(rows["email"].to_pylist(), rows["name"].to_pylist(), strict=True):
        stays.append(email not in emails and name not in names)
        if stays[-1]:
            emails.add(email)
            names.add(name)
    return rows.filter(pa.array(stays, pa.bool_())).select(["_part", "_rank"])


def _settle_parts(open_rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of the parts that fit a task, and the rows of larger parts.

    Rows that share no email or name, not even through others, cannot meet.  So
    the parts that hang together are settled each by itself: in order, in one pass.
    """
    email, name = F.xxhash64(F.lit("email"), "email"), F.xxhash64(F.lit("name"), "name")
    found = components(open_rows.select(email.alias("a"), name.alias("b")), "a", "b")
    # A row's email is a node with a root, unless it is the root itself.
    roots = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    placed = (
        open_rows.withColumn("_node", email)
        .join(roots, "_node", "left")
        .withColumn("_part", F.coalesce("_root", "_node"))
        .drop("_node", "_root")
    )
    placed = materialize(placed, "parts")
    sizes = materialize(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    small = sizes.where(F.col("_size") <= part_rows).select("_part")
    large = placed.join(sizes.where(F.col("_size") > part_rows).select("_part"), "_part", "left_semi")
    ranked = materialize(
        rank_rows(placed.join(small, "_part", "left_semi"), ["_part"], ["seq"], "_rank", large=False), "ranked"
    )
    settled = (
        ranked.select("_part", "_rank", "email", "name")
        .groupBy("_part")
        .applyInArrow(_in_order, "_part bigint, _rank bigint")
    )
    accepted = ranked.join(settled, ["_part", "_rank"]).select("seq", "email", "name")
    return materialize(accepted, "accepted"), materialize(large.select("seq", "email", "name"), "undecided")


def accept_signups(signups: DataFrame, rounds: int = ROUNDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(seq, email, name) of the signups accepted, as if taken one by one in ``seq`` order.

    A signup is accepted when no earlier *accepted* one has its email or its
    name.  Each round accepts the rows that are first among the undecided for
    both, and drops those that meet an accepted one.  After ``rounds`` rounds,
    what is left is taken apart into rows that hang together by emails and names;
    parts of up to ``part_rows`` rows are settled in one pass each, whatever the
    length of their chains.  Larger ones go on in rounds, each of which decides
    at least the earliest row left, and are taken apart again.
    """
    open_rows = materialize(signups.select("seq", "email", "name"), "signups")
    accepted = []
    done = 0
    while not open_rows.isEmpty():
        done += 1
        if done % (rounds + 1) == 0:
            settled, open_rows = _settle_parts(open_rows, part_rows)
            accepted.append(settled)
            continue
        winners = materialize(_first_of_both(open_rows), "accepted")
        accepted.append(winners)
        open_rows = materialize(
            open_rows.join(winners.select("email"), "email", "left_anti")
            .join(winners.select("name"), "name", "left_anti")
            .select("seq", "email", "name"),
            "undecided",
        )
    if not accepted:
        return open_rows
    return materialize(reduce(DataFrame.unionByName, accepted), "accepted")


def signup_batch(signups: DataFrame, users: DataFrame) -> DataFrame:
    """(seq, email, name, status) for a batch of signups against the users known.

    Signups that meet a known user never claim anything, so they are set aside
    before the rounds.
    """
    known_email = users.select("email").distinct().withColumn("_known_email", F.lit(True))
    known_name = users.select("name").distinct().withColumn("_known_name", F.lit(True))
    checked = (
        signups.join(known_email, "email", "left")
        .join(known_name, "name", "left")
        .select("seq", "email", "name", "_known_email", "_known_name")
    )
    checked = materialize(checked, "checked")
    complete = F.col("email").isNotNull() & F.col("name").isNotNull()
    unknown = F.col("_known_email").isNull() & F.col("_known_name").isNull()
    fresh = checked.where(complete & unknown)
    taken = accept_signups(fresh)
    email_at = taken.select("email", F.col("seq").alias("_email_seq"))
    name_at = taken.select("name", F.col("seq").alias("_name_seq"))
    email_taken = F.col("_known_email") | (F.col("_email_seq") < F.col("seq"))
    name_taken = F.col("_known_name") | (F.col("_name_seq") < F.col("seq"))
    status = F.coalesce(
        required("email", "name"),
        F.when(email_taken, EMAIL_TAKEN),
        F.when(name_taken, NAME_TAKEN),
        F.lit(OK),
    )
    return (
        checked.join(email_at, "email", "left")
        .join(name_at, "name", "left")
        .select("seq", "email", "name", status.alias("status"))
    )


def login_batch(logins: DataFrame, users: DataFrame) -> DataFrame:
    """The outcome of a batch of logins, one row for each email.

    ``logins`` needs event_id, email, issued and token.  The last login's token
    replaces the user's others and dates the user's last visit; the password is
    not compared.  Logins are cut to the last of each email before the join.
    """
    last = logins.groupBy("email").agg(
        F.count(F.lit(1)).alias("logins"),
        F.max_by(F.struct("token", "issued"), F.struct("issued", "event_id")).alias("_last"),
    )
    known = F.col("id").isNotNull()
    return last.join(users.select("id", "email"), "email", "left").select(
        "email",
        F.col("id").alias("user_id"),
        "logins",
        F.when(known, OK).otherwise(UNREGISTERED).alias("status"),
        F.when(known, F.col("_last.token")).alias("token"),
        F.when(known, expiry(F.col("_last.issued"))).alias("expire_date"),
        F.when(known, to_second(F.col("_last.issued"))).alias("last_login_date"),
    )


def apply_logins(users: DataFrame, outcome: DataFrame) -> DataFrame:
    """``users`` with the last login dates of a batch."""
    dates = outcome.where(F.col("status") == OK).select(
        F.col("user_id").alias("id"), F.col("last_login_date").alias("_last")
    )
    return (
        users.join(dates, "id", "left")
        .withColumn("last_login_date", F.coalesce("_last", "last_login_date"))
        .select(*users.columns)
    )
