"""Index requests to crawl tasks, and crawl tasks to stat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.operators.accounts import OK, authorize
from webtrawl.operators.requests import required
from webtrawl.operators.tables import upsert
from webtrawl.operators.tasks import route_tasks
from webtrawl.sources.messages import task_body


def route_index_requests(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Status of each index request and the task it publishes.

    ``requests`` needs request_id, domain, token and ts.  A missing domain is
    reported before a missing token.
    """
    status = F.coalesce(required("domain"), F.col("status"))
    ok = F.col("status") == OK
    return (
        authorize(requests, tokens, users)
        .withColumn("status", status)
        .select(
            "request_id",
            "status",
            F.when(ok, F.md5(F.concat(F.lit("task:"), F.col("request_id").cast("string")))).alias(
                "task_id"
            ),
            F.when(ok, F.col("author_id")).alias("author_id"),
            F.when(ok, task_body(F.col("domain"), F.col("author_id"))).alias("body"),
        )
    )


def apply_tasks(tasks: DataFrame, stats: DataFrame, as_of: Column) -> DataFrame:
    """The stat table after a batch of tasks: new crawls, copies and error rows merged in."""
    routed = route_tasks(tasks, stats, as_of).where(F.col("action") != "skip")
    rows = routed.withColumn("time", as_of).select(
        *[F.col(c) if c in ("time", *routed.columns) else F.lit(None).alias(c) for c in stats.columns]
    )
    typed = rows.select(*[F.col(c).cast(stats.schema[c].dataType) for c in stats.columns])
    return upsert(stats, typed, ["domain", "author_id"], ["time"])
