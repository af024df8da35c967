"""Requests matched with replies, and tokens checked, while messages arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webtrawl.functions.times import MICROS, floor_div
from webtrawl.operators.accounts import INVALID_TOKEN, OK, TOKEN_EXPIRED
from webtrawl.operators.replies import REPLY_SECONDS, TIMEOUT
from webtrawl.streaming.run import keep_state_in_rocksdb

# How long an expired token is told from an unknown one.
EXPIRED_SECONDS = 86_400


def _ms(micros: int) -> int:
    """The first millisecond that is not before an instant in microseconds."""
    return -(-micros // 1000)


class ReplyMatcher(StatefulProcessor):
    """Requests and replies of one id and span of time, kept until they are settled.

    Nothing is decided when a row comes.  A timer goes off when the watermark has
    passed a reply or a deadline: no earlier reply can come then, so the first one
    wins, or the request has timed out, whatever the order of arrival was.
    """

    def __init__(self, timeout: int):
        self.timeout = timeout * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "at bigint")
        self.replies = handle.getListState("replies", "at bigint, body string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            if row.kind == 0:
                self.requests.appendValue((row.at,))
                self.handle.registerTimer(_ms(row.at + self.timeout))
            else:
                self.replies.appendValue((row.at, row.body))
                self.handle.registerTimer(_ms(row.at))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        replies = sorted((a, b is not None, b or "") for a, b in self.replies.get())
        waiting, settled = [], []
        for (at,) in self.requests.get():
            first = next((r for r in replies if at <= r[0] <= at + self.timeout), None)
            if first and first[0] <= passed:
                settled.append((at, first[0], first[2] if first[1] else None, OK))
            elif at + self.timeout <= passed:
                settled.append((at, None, None, TIMEOUT))
            else:
                waiting.append((at,))
        # Requests still to come are later than the watermark, and so than these replies.
        earliest = min(waiting, default=(passed,))[0]
        useful = [(a, b if has else None) for a, has, b in replies if a > passed or a >= earliest and waiting]
        for state, rows in ((self.requests, waiting), (self.replies, useful)):
            state.put(rows) if rows else state.clear()
        for at, reply_at, body, status in settled:
            yield Row(correlation_id=key[0], request_at=at, reply_at=reply_at, reply=body, status=status)

    def close(self) -> None:
        pass


MATCHED = "correlation_id string, request_at bigint, reply_at bigint, reply string, status string"


def match_replies_stream(
    requests: DataFrame, replies: DataFrame, timeout: int = REPLY_SECONDS, late: str = "10 seconds"
) -> DataFrame:
    """Each request with its first reply in time, or the timeout status: one row a request.

    Both streams need correlation_id, ts (``timestamp``) and body; rows without
    ts, and replies without id, are left out.  The rows are those of the batch
    form, as long as no message is later than ``late``; a row comes out once the
    watermark of both sides has passed its reply or its deadline.

    The state is kept by id and span of ``timeout`` seconds, a reply going to its
    own span and the one before.  So an id with most of the messages has many
    keys, and each holds one span of time.
    """
    keep_state_in_rocksdb(requests.sparkSession)
    at = F.unix_micros("ts")
    span = timeout * MICROS
    asked = requests.select(
        "correlation_id", "ts", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("body"),
        F.array(floor_div(at, span)).alias("spans"),
    )
    answered = replies.where(F.col("correlation_id").isNotNull()).select(
        "correlation_id", "ts", F.lit(1).alias("kind"), "body",
        F.array(floor_div(at, span) - 1, floor_div(at, span)).alias("spans"),
    )
    both = [s.where(F.col("ts").isNotNull()).withWatermark("ts", late) for s in (asked, answered)]
    events = both[0].unionByName(both[1]).withColumns({"at": at, "span": F.explode("spans")}).drop("spans")
    matched = events.groupBy("correlation_id", "span").transformWithState(
        statefulProcessor=ReplyMatcher(timeout), outputStructType=MATCHED, outputMode="Append", timeMode="EventTime"
    )
    return matched.select(
        "correlation_id",
        F.timestamp_micros("request_at").alias("request_ts"),
        F.timestamp_micros("reply_at").alias("reply_ts"),
        "reply",
        "status",
    )


class TokenKeeper(StatefulProcessor):
    """The expiry of one token, from its issue until it was expired for a while."""

    def __init__(self, keep: int):
        self.keep = keep * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at bigint")

    def _issue(self, at: int | None) -> None:
        if at is None:
            self.expiry.clear()
        else:
            self.expiry.update((at,))
            self.handle.registerTimer(_ms(at + self.keep) + 1)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._issue(initialState.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r.at, r.kind, r.expiry is not None, r.expiry or 0)):
            if row.kind == 0:
                self._issue(row.expiry)
                continue
            known = self.expiry.get()
            # To the second, and an expiry at this second still holds.
            second = row.at // MICROS * MICROS
            status = INVALID_TOKEN if known is None else TOKEN_EXPIRED if known[0] < second else OK
            yield Row(request_id=row.request_id, token=key[0], at=row.at, status=status)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.expiry.get()
        # A token issued again has a later timer.
        if known is not None and known[0] + self.keep < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.expiry.clear()
        return iter(())

    def close(self) -> None:
        pass


def _expiry(expire_date: str) -> Column:
    return F.unix_micros(F.col(expire_date).cast("timestamp"))


def validate_tokens_state(
    requests: DataFrame,
    issued: DataFrame,
    tokens: DataFrame,
    late: str = "10 seconds",
    keep: int = EXPIRED_SECONDS,
) -> DataFrame:
    """Status of each request's token, against tokens that come, go and expire meanwhile.

    ``requests`` needs request_id, token and ts, ``issued`` token, expire_date and
    ts; a null expire_date takes a token back.  ``tokens`` (token, expire_date, the
    latest of each token) are those known before.  A batch is taken in the order
    of ts, issues first; of one token, tokens issued in one instant by expiry.

    A token leaves the state ``keep`` seconds after its expiry, by an event-time
    timer, so that a replayed log gives the same; from then on it is unknown.
    Time-to-live settings count processing time and would not.  Requests without
    token are invalid without a look at the state.
    """
    keep_state_in_rocksdb(requests.sparkSession)
    asked = requests.select(
        "token", "ts", F.lit(1).alias("kind"), F.col("request_id").cast("string").alias("request_id"),
        F.lit(None).cast("bigint").alias("expiry"),
    )
    new = issued.where(F.col("token").isNotNull()).select(
        "token", "ts", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("request_id"),
        _expiry("expire_date").alias("expiry"),
    )
    named = F.col("token").isNotNull() & F.col("ts").isNotNull()
    both = [s.where(named).withWatermark("ts", late) for s in (asked, new)]
    events = both[0].unionByName(both[1]).withColumn("at", F.unix_micros("ts"))
    known = tokens.where(F.col("token").isNotNull()).groupBy("token").agg(F.max(_expiry("expire_date")).alias("expiry"))
    checked = events.groupBy("token").transformWithState(
        statefulProcessor=TokenKeeper(keep),
        outputStructType="request_id string, token string, at bigint, status string",
        outputMode="Append",
        timeMode="EventTime",
        initialState=known.groupBy("token"),
    )
    return checked.select("request_id", "token", F.timestamp_micros("at").alias("ts"), "status")


def validate_tokens_stream(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Status of each request's token against a stored token table.

    Expired rows stay in the table; the expiry is tested when a token is read.
    ``ts`` is a ``timestamp``, ``expire_date`` a ``timestamp_ntz`` in the
    session's zone.
    """
    expired = F.col("expire_date").cast("timestamp") < F.date_trunc("second", F.col("ts"))
    status = (
        F.when(F.col("expire_date").isNull(), INVALID_TOKEN)
        .when(expired, TOKEN_EXPIRED)
        .otherwise(OK)
    )
    return requests.join(tokens.select("token", "expire_date"), "token", "left").select(
        "request_id", "token", "ts", status.alias("status")
    )
