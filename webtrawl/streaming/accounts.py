"""Account messages as they come: sign-ups, logins, token checks."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.functions.times import expiry, time_text, to_second
from webtrawl.operators.accounts import OK, USER_COLUMNS, validate_tokens
from webtrawl.operators.requests import required
from webtrawl.operators.tables import assign_ids
from webtrawl.plans.accounts import login_batch, signup_batch
from webtrawl.schemas import TOKENS, USERS
from webtrawl.sources.changes import ChangeTable
from webtrawl.sources.messages import error_body, parse_messages, reply_body
from webtrawl.sources.scratch import materialize
from webtrawl.streaming.run import Handler

# Fixed value: status of a message of no known type; malformed ones get it too.
UNKNOWN_TYPE = "unknown type"

REPLIES = T.StructType(
    [
        T.StructField("correlation_id", T.StringType()),
        T.StructField("reply_to", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)


@dataclass(frozen=True)
class AccountTables:
    users: ChangeTable
    tokens: ChangeTable
    replies: ChangeTable

    @classmethod
    def below(cls, spark, path: str) -> AccountTables:
        return cls(
            ChangeTable(spark, f"{path}/users", USERS.schema, ("id",)),
            # One row for each user: a new token replaces the old one.
            ChangeTable(spark, f"{path}/tokens", TOKENS.schema, ("user_id",)),
            ChangeTable(spark, f"{path}/replies", REPLIES),
        )

    def start(self, users: DataFrame | None = None, tokens: DataFrame | None = None) -> AccountTables:
        self.users.start(users)
        self.tokens.start(tokens)
        self.replies.start()
        return self


def new_token(message_id: Column, secret: str) -> Column:
    """A token text made from the message's id and a secret, so that only its holder can.

    A batch that runs again gives the same one.
    """
    inner = F.sha2(F.concat(F.lit("inner:" + secret), message_id), 256)
    digest = F.sha2(F.concat(F.lit("outer:" + secret), inner), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in parts])


def distinct_messages(messages: DataFrame) -> DataFrame:
    """``messages`` without redeliveries, each with a ``message_id`` of its own.

    A redelivery has the correlation id, reply_to and body of another message; the
    earliest ts stays.  Messages without a correlation id are all kept, as nothing
    tells a redelivery from a second message; equal ones are numbered.  The result
    is the same however often and in whatever order the rows are read.
    """
    same = ["correlation_id", "reply_to", "body"]
    named = F.col("correlation_id").isNotNull()
    once = messages.where(named).groupBy(*same).agg(F.min("ts").alias("ts"))
    own = F.sha2(F.to_json(F.struct(*same)), 256)
    # Equal messages are counted before they meet, so that they may be many.
    counted = messages.where(~named).groupBy(*same, "ts").agg(F.count(F.lit(1)).alias("_n"))
    every = counted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    at = F.col("ts").cast("string").alias("ts")
    numbered = F.sha2(F.to_json(F.struct("reply_to", "body", at, "_k")), 256)
    return once.withColumn("message_id", own).unionByName(
        every.withColumn("message_id", numbered).drop("_n", "_k")
    )


def account_handler(tables: AccountTables, secret: str | None = None) -> Handler:
    """Handles a batch of signup, login and validate messages.

    ``secret`` keys the session tokens; a stream that is started again should be
    given the one it had.  Without one, a random secret holds as long as the handler.
    A message delivered twice in a batch counts once, see :func:`distinct_messages`;
    different messages that share a correlation id, or have none, all count.

    Within a batch sign-ups come first, then logins, then token checks; each
    step sees the tables as the steps before left them.
    """

    key = secret or secrets.token_hex(32)

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables.users.snapshot_if_due(batch_id)
        tables.tokens.snapshot_if_due(batch_id)
        parsed = materialize(parse_messages(distinct_messages(batch)), "messages")
        message = parsed.where(~F.col("malformed")).select(
            "message_id",
            "correlation_id",
            "reply_to",
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            "message.type",
            "message.data.email",
            "message.data.name",
            "message.data.token",
        )
        users, tokens = tables.users.current(batch_id), tables.tokens.current(batch_id)

        signups = message.where(F.col("type") == "signup").select(
            F.struct("ts", "correlation_id", "message_id").alias("seq"), "email", "name", "reply_to"
        )
        signed = materialize(
            signup_batch(signups, users).join(signups.select("seq", "reply_to"), "seq"), "signed"
        )
        joined = materialize(
            assign_ids(users, signed.where(F.col("status") == OK), "id", ["seq"]), "joined"
        )
        at = to_second(F.col("seq.ts"))
        new_users = joined.select(
            F.col("id").cast("int"),
            "email",
            "name",
            at.alias("created_date"),
            at.alias("last_login_date"),
        )
        first_tokens = joined.select(
            new_token(F.col("seq.message_id"), key).alias("token"),
            F.col("id").cast("int").alias("user_id"),
            expiry(F.col("seq.ts")).alias("expire_date"),
        )
        known = users.unionByName(new_users)

        logins = message.where(F.col("type") == "login").select(
            F.struct("correlation_id", "message_id").alias("event_id"),
            "email",
            "reply_to",
            F.col("ts").alias("issued"),
            new_token(F.col("message_id"), key).alias("token"),
        )
        outcome = materialize(login_batch(logins, known), "logins")
        replaced = outcome.where(F.col("status") == OK).select("token", "user_id", "expire_date")
        dates = outcome.select(F.col("user_id").alias("id"), F.col("last_login_date").alias("_last"))
        visited = (
            known.join(dates, "id")
            .withColumn("last_login_date", F.coalesce("_last", "last_login_date"))
            .select(*known.columns)
        )
        same_user = [c for c in USER_COLUMNS if c != "last_login_date"]
        unvisited = new_users.join(visited.select("id"), "id", "left_anti")
        tables.users.write(visited.unionByName(unvisited.select(*same_user, "last_login_date")), batch_id)
        kept_first = first_tokens.join(replaced.select("user_id"), "user_id", "left_anti")
        tables.tokens.write(replaced.unionByName(kept_first), batch_id)

        # The tables as this batch left them.
        users_now, tokens_now = tables.users.current(batch_id + 1), tables.tokens.current(batch_id + 1)
        checks = message.where(F.col("type") == "validate").select(
            F.col("message_id").alias("request_id"), "token", "ts", "correlation_id", "reply_to"
        )
        checked = validate_tokens(checks, tokens_now, users_now).join(
            checks.select("request_id", "correlation_id", "reply_to"), "request_id"
        )

        session = ["token", "expire_date"]
        signup_replies = signed.join(
            first_tokens.join(joined.select(F.col("id").alias("user_id"), "seq"), "user_id"), "seq", "left"
        ).select(
            F.col("seq.correlation_id").alias("correlation_id"),
            "reply_to",
            reply_body(F.col("status"), F.struct(*_texts(session))).alias("body"),
        )
        # Null-safe, so that a login without email is answered, too.
        asked = logins.select("event_id", F.col("email").alias("_asked"), "reply_to")
        issued = asked.join(outcome, F.col("_asked").eqNullSafe(F.col("email")))
        login_replies = issued.select(
            F.col("event_id.correlation_id").alias("correlation_id"),
            "reply_to",
            reply_body(
                F.coalesce(required("email"), F.col("status")), F.struct(*_texts(session))
            ).alias("body"),
        )
        check_replies = checked.select(
            "correlation_id",
            "reply_to",
            reply_body(F.col("status"), F.struct(*_texts(USER_COLUMNS))).alias("body"),
        )
        types = F.coalesce(F.col("message.type"), F.lit("")).isin("signup", "login", "validate")
        others = parsed.where(F.col("malformed") | ~types).select(
            "correlation_id",
            "reply_to",
            error_body(F.lit(UNKNOWN_TYPE)).alias("body"),
        )
        replies = signup_replies.unionByName(login_replies).unionByName(check_replies)
        tables.replies.write(replies.unionByName(others), batch_id)

    return handle


def _texts(columns) -> list[Column]:
    """Columns with instants as texts of second precision."""
    return [
        time_text(F.col(c)).alias(c) if c.endswith("_date") else F.col(c) for c in columns
    ]
