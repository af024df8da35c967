"""The JSON answers to requests, one for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.times import time_text
from webtrawl.operators.accounts import OK, USER_COLUMNS, authorize, spread_nulls
from webtrawl.operators.requests import required
from webtrawl.sources.messages import error_body, reply_body


def search_responses(checked: DataFrame, hits: DataFrame) -> DataFrame:
    """(request_id, body): the urls of each request's page, best first, or why it was refused.

    ``checked`` holds request_id and status, ``hits`` the ranked hits.  A page
    has at most a hundred urls, so gathering it into one row is safe.
    """
    pages = hits.groupBy("request_id").agg(F.collect_list(F.struct("rank", "url")).alias("_page"))
    urls = F.transform(F.array_sort("_page"), lambda hit: hit["url"])
    data = F.coalesce(urls, F.array().cast("array<string>"))
    full = F.to_json(F.struct(F.col("status"), data.alias("data")))
    body = F.when(F.col("status") == OK, full).otherwise(error_body(F.col("status")))
    return (
        checked.select("request_id", "status")
        .join(pages, "request_id", "left")
        .select("request_id", body.alias("body"))
    )


def current_responses(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, body): the caller's own user row, or why there is none."""
    user = F.struct(
        *[time_text(F.col(c)).alias(c) if c.endswith("_date") else F.col(c) for c in USER_COLUMNS]
    )
    return authorize(requests, tokens, users, keep=USER_COLUMNS).select(
        "request_id", reply_body(F.col("status"), user).alias("body")
    )


def index_responses(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, body): the caller's id for an index request, or why it was refused."""
    status = F.coalesce(required("domain"), F.col("status"))
    answered = authorize(requests, tokens, users).withColumn("status", status)
    data = F.struct(F.col("author_id").alias("id"))
    return answered.select("request_id", reply_body(F.col("status"), data).alias("body"))


def stat_answers(
    requests: DataFrame, tokens: DataFrame, users: DataFrame, stats: DataFrame
) -> DataFrame:
    """(request_id, status, author_id, crawls, body), one row for each request for crawl stats.

    A good request is answered by its caller's ``crawls`` rows of the stats, which
    stay in their table (:func:`caller_stats`): a caller may have any number of
    them.  A refused one has its body here.
    """
    owned = stats.groupBy(F.col("author_id").alias("_author")).agg(F.count(F.lit(1)).alias("crawls"))
    asked = authorize(requests, tokens, users)
    key = spread_nulls(asked["author_id"].cast("string"), asked["request_id"])
    ok = F.col("status") == OK
    return asked.join(owned, key == owned["_author"].cast("string"), "left").select(
        "request_id",
        "status",
        "author_id",
        F.when(ok, F.coalesce("crawls", F.lit(0))).alias("crawls"),
        F.when(~ok, error_body(F.col("status"))).alias("body"),
    )
