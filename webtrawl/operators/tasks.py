"""Crawl tasks against the domains already crawled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.links import https_flag
from webtrawl.functions.times import seconds

# Fixed values.
RECRAWL_SECONDS = 86_399
CRAWLING = "Crawling"
NO_PROTOCOL = "Error: protocol should be specified"


def crawled_recently(time: Column, as_of: Column) -> Column:
    """Within the recrawl period before ``as_of``, its far end included."""
    return time >= as_of - seconds(RECRAWL_SECONDS)


def recrawl_filter(stats: DataFrame, as_of: Column) -> DataFrame:
    """The newest row of each domain, and whether it is too fresh to crawl again."""
    newest = newest_stat(with_crawl_time(stats))
    return newest.withColumn("skip", crawled_recently(F.col("crawled_at"), as_of)).select(
        *stats.columns, "skip"
    )


def with_crawl_time(stats: DataFrame) -> DataFrame:
    """``stats`` with ``crawled_at``: when a row's domain was crawled, else when it was written."""
    known = F.col("crawled_at") if "crawled_at" in stats.columns else F.lit(None).cast("timestamp_ntz")
    return stats.withColumn("crawled_at", F.coalesce(known, F.col("time")))


def newest_stat(stats: DataFrame) -> DataFrame:
    """One row for each domain: the newest crawl, of equals the one with the smallest author."""
    others = [c for c in stats.columns if c != "domain"]
    when = F.col("crawled_at") if "crawled_at" in stats.columns else F.col("time")
    order = F.struct(when, F.col("time"), -F.col("author_id"))
    return (
        stats.groupBy("domain")
        .agg(F.max_by(F.struct(*others), order).alias("_row"))
        .select("domain", *[F.col("_row")[c].alias(c) for c in others])
    )


def classify_protocol(domains: DataFrame) -> DataFrame:
    """Domains with the https flag, and the error status of those without a protocol."""
    flag = https_flag(F.col("domain"))
    return domains.withColumns(
        {"https": flag, "error": F.when(flag.isNull(), F.lit(NO_PROTOCOL))}
    )


def route_tasks(tasks: DataFrame, stats: DataFrame, as_of: Column) -> DataFrame:
    """What a batch of tasks (task_id, domain, author_id, ts) does, one row per domain and author.

    ``action`` is one of

    - ``skip``: the domain is fresh and this author has it already;
    - ``copy``: another author's fresh domain, or one asked for earlier in this
      batch, is entered for this author too;
    - ``crawl``: a new crawl starts;
    - ``error``: the domain names no protocol.

    The stat columns are those of the row to write (null for ``skip``).  A task
    without a domain is an error, and one without an author is an author's like
    any other.  Tasks are cut to the first of each domain and author before
    anything is joined.  What makes a domain fresh is when it was crawled: a copy
    carries that time on in ``crawled_at``, where ``stats`` has such a column.
    """
    first = tasks.groupBy("domain", "author_id").agg(
        F.min(F.struct("ts", "task_id")).alias("_first"), F.count(F.lit(1)).alias("tasks")
    )
    leader = first.groupBy(F.col("domain").alias("_led")).agg(F.min("_first").alias("_leader"))
    known = newest_stat(with_crawl_time(stats)).select(
        F.col("domain").alias("_stat"), F.col("status").alias("_known"), F.col("crawled_at").alias("_crawled")
    )
    owned = stats.select(
        F.col("domain").alias("_domain"), F.col("author_id").alias("_author"), F.lit(True).alias("_owned")
    ).distinct()
    flag = https_flag(F.col("domain"))
    fresh = F.coalesce(crawled_recently(F.col("_crawled"), as_of), F.lit(False))
    action = (
        F.when(fresh & F.col("_owned"), "skip")
        .when(fresh, "copy")
        .when(F.col("_first") != F.col("_leader"), "copy")
        .when(flag.isNull(), "error")
        .otherwise("crawl")
    )
    status = (
        F.when(F.col("action") == "skip", F.lit(None))
        .when(fresh, F.col("_known"))
        .when(flag.isNull(), NO_PROTOCOL)
        .otherwise(CRAWLING)
    )
    written = F.col("action") != "skip"
    same_author = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("author_id").eqNullSafe(F.col("_author"))
    routed = (
        first.join(owned, same_author, "left")
        .join(leader, F.col("domain").eqNullSafe(F.col("_led")))
        .join(known, F.col("domain").eqNullSafe(F.col("_stat")), "left")
        .withColumn("action", action)
    )
    carried = [F.when(written & fresh, F.col("_crawled")).alias("crawled_at")]
    return routed.select(
        F.col("_first.task_id").alias("task_id"),
        "domain",
        "author_id",
        "tasks",
        "action",
        status.alias("status"),
        F.when(written, F.coalesce(flag, F.lit(0))).alias("https"),
        F.when(written, F.lit(0)).alias("pages_count"),
        *(carried if "crawled_at" in stats.columns else []),
    )
