"""Tokens, their lifetimes, and the requests that carry them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.times import expiry, is_expired
from webtrawl.operators.ordered import TASK_ROWS, next_value

# Statuses.
OK = "ok"
FORBIDDEN = "forbidden"
INVALID_TOKEN = "Invalid token"
TOKEN_EXPIRED = "Token expired"
UNKNOWN_USER = "unknown user"
EMAIL_TAKEN = "User with this email already exists"
NAME_TAKEN = "User with this name already exists"
UNREGISTERED = "Unregistered user"

USER_COLUMNS = ("id", "email", "name", "created_date", "last_login_date")


def spread_nulls(key: Column, by: Column) -> Column:
    """``key`` with its nulls made distinct, so that an outer join does not pile them on one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), by.cast("string")))


def latest_token(logins: DataFrame) -> DataFrame:
    """The live token of each user: that of the last login.

    ``logins`` needs user_id, event_id, issued and token.  A greatest-value
    aggregate is combined before the shuffle, so a busy user costs one row per task.
    """
    newest = F.max_by(F.struct("token", "issued"), F.struct("issued", "event_id"))
    return (
        logins.groupBy("user_id")
        .agg(newest.alias("_last"))
        .select("user_id", "_last.token", expiry(F.col("_last.issued")).alias("expire_date"))
    )


def token_lifetimes(logins: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Each token with its issue, the user's next login (which deletes it) and its expiry."""
    return next_value(
        logins, ["user_id"], ["issued", "event_id"], "issued", "superseded", task_rows
    ).select(
        "token", "user_id", "issued", "superseded", expiry(F.col("issued")).alias("expire_date")
    )


def _with_owner(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with their token's row and its user, each null where there is none.

    Tokens come first, so that users are looked up only for the requests at hand.
    """
    issued = tokens.select(
        F.col("token").alias("_token"), F.col("user_id").alias("_user"), "expire_date"
    )
    key = spread_nulls(requests["token"], requests["request_id"])
    known = requests.join(issued, key == issued["_token"], "left")
    owner = spread_nulls(known["_user"].cast("string"), requests["request_id"])
    found = users.select(*USER_COLUMNS, F.col("id").cast("string").alias("_owner"))
    return known.join(found, owner == found["_owner"], "left").drop("_owner", "_user")


def _token_status(now: Column) -> Column:
    return (
        F.when(F.col("_token").isNull(), INVALID_TOKEN)
        .when(is_expired(F.col("expire_date"), now), TOKEN_EXPIRED)
        .when(F.col("id").isNull(), UNKNOWN_USER)
        .otherwise(OK)
    )


def validate_tokens(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Status of each request's token, and its user where the status is ok.

    ``requests`` needs request_id, token and ts.
    """
    return (
        _with_owner(requests, tokens, users)
        .withColumn("status", _token_status(requests["ts"]))
        .select(
            "request_id",
            "status",
            *[F.when(F.col("status") == OK, F.col(c)).alias(c) for c in USER_COLUMNS],
        )
    )


def token_validity(requests: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Status of each request's token at the instant of the request.

    A token not issued yet or already replaced does not exist at that instant.
    The equality on the token keeps this a hash or sort-merge join.
    """
    life = lifetimes.withColumnRenamed("token", "_token").drop("user_id")
    key = spread_nulls(requests["token"], requests["request_id"])
    live = (
        (key == life["_token"])
        & (requests["ts"] >= life["issued"])
        & (life["superseded"].isNull() | (requests["ts"] < life["superseded"]))
    )
    status = (
        F.when(F.col("_token").isNull(), INVALID_TOKEN)
        .when(is_expired(F.col("expire_date"), requests["ts"]), TOKEN_EXPIRED)
        .otherwise(OK)
    )
    return requests.join(life, live, "left").select(
        "request_id", "token", "ts", status.alias("status")
    )


def authorize(
    requests: DataFrame, tokens: DataFrame, users: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Requests with a status and, where it is ok, the caller's id and the ``keep`` columns.

    A request without a token is forbidden before any lookup.
    """
    status = F.when(requests["token"].isNull(), FORBIDDEN).otherwise(_token_status(requests["ts"]))
    ok = F.col("status") == OK
    return (
        _with_owner(requests, tokens, users)
        .withColumn("status", status)
        .select(
            *[requests[c] for c in requests.columns],
            "status",
            F.when(ok, F.col("id")).alias("author_id"),
            *[F.when(ok, F.col(c)).alias(c) for c in keep],
        )
    )


def caller_stats(authorized: DataFrame, stats: DataFrame) -> DataFrame:
    """The crawl rows of every caller with a good token, and how many requests they answer.

    Requests are counted by caller first: the join gives each stat row once,
    however often a caller asked.
    """
    callers = (
        authorized.where(F.col("status") == OK)
        .groupBy("author_id")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return stats.join(callers, "author_id").select(
        "author_id", "domain", "status", "time", F.col("pages_count").alias("pages"), "requests"
    )


def signup_conflicts(signups: DataFrame, users: DataFrame) -> DataFrame:
    """Signups against the users already known; a taken email is named before a taken name."""
    emails = users.select("email").distinct().withColumn("_email_taken", F.lit(True))
    names = users.select("name").distinct().withColumn("_name_taken", F.lit(True))
    return (
        signups.join(emails, "email", "left")
        .join(names, "name", "left")
        .select(
            *signups.columns,
            F.when(F.col("_email_taken"), EMAIL_TAKEN)
            .when(F.col("_name_taken"), NAME_TAKEN)
            .otherwise(OK)
            .alias("status"),
        )
    )
