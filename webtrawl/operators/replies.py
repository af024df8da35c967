"""Requests matched with their replies by correlation id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.times import seconds
from webtrawl.operators.ordered import TASK_ROWS, nearest_following

# Fixed values.
REPLY_SECONDS = 5
TIMEOUT = "Timeout exceeded"


def match_replies(
    requests: DataFrame,
    replies: DataFrame,
    timeout: int = REPLY_SECONDS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Each request with its first reply in time, or the timeout status.

    Both sides need correlation_id, ts and body.  One row for each request;
    repeated requests keep theirs, and one reply may answer several.  Of replies
    of one instant the smallest body counts.  A reply from before its request is
    none, and nothing answers a request without id or instant.

    An as-of merge: requests and replies of an id go into one order, where the
    next reply is carried backwards.  No pair of the two sides arises, and an id
    with most of the rows spreads over tasks.
    """
    asked = requests.select("correlation_id", "ts", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("body"))
    answers = replies.select("correlation_id", "ts", F.lit(1).alias("_kind"), F.col("body").cast("string").alias("body"))
    named = F.col("correlation_id").isNotNull() & F.col("ts").isNotNull()
    answer = F.when(F.col("_kind") == 1, F.struct("ts", "body"))
    merged = asked.unionByName(answers).where(named).withColumn("_answer", answer)
    followed = nearest_following(
        merged, ["correlation_id"], ["ts", "_kind", "body"], "_answer", "_next", task_rows
    ).where("_kind = 0")
    in_time = F.col("_next.ts") <= F.col("ts") + seconds(timeout)
    matched = followed.select("correlation_id", "ts", F.when(in_time, F.col("_next")).alias("_reply"))
    never = asked.where(~named).select(
        "correlation_id", "ts", F.lit(None).cast(matched.schema["_reply"].dataType).alias("_reply")
    )
    return matched.unionByName(never).select(
        "correlation_id",
        F.col("ts").alias("request_ts"),
        F.col("_reply.ts").alias("reply_ts"),
        F.col("_reply.body").alias("reply"),
        F.when(F.col("_reply").isNotNull(), "ok").otherwise(TIMEOUT).alias("status"),
    )
