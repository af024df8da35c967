"""Crawl statistics by root.  All grouping is partial-then-final, so a large root is cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.operators.ordered import TASK_ROWS, rank_rows

# Fixed value: progress is stored at each tenth page.
PROGRESS_STEP = 10


def page_counts(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy("root").agg(F.count(F.lit(1)).alias("pages_count"))


def time_stats(fetches: DataFrame) -> DataFrame:
    """Mean, longest and shortest time per page, from ``duration``."""
    return fetches.groupBy("root").agg(
        F.avg("duration").alias("avg_time_per_page"),
        F.max("duration").alias("max_time_per_page"),
        F.min("duration").alias("min_time_per_page"),
    )


def progress(
    fetches: DataFrame, order: list[str], step: int = PROGRESS_STEP, task_rows: int = TASK_ROWS
) -> DataFrame:
    """The progress rows of each root: page count and instant at each ``step``-th page."""
    ranked = rank_rows(fetches.select("root", *order), ["root"], order, "pages_count", task_rows)
    return ranked.where(F.col("pages_count") % step == 0)


def crawl_status(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    """``Done`` for a root once none of its urls waits, else ``Crawling``.

    ``frontier`` holds the (root, url) pairs known, ``fetched`` those fetched.
    """
    done = fetched.select("root", "url").distinct().withColumn("_done", F.lit(1))
    return (
        frontier.select("root", "url")
        .distinct()
        .join(done, ["root", "url"], "left")
        .groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("known"),
            F.count("_done").alias("pages_count"),
        )
        .select(
            "root",
            "pages_count",
            (F.col("known") - F.col("pages_count")).alias("pending"),
            F.when(F.col("known") == F.col("pages_count"), "Done")
            .otherwise("Crawling")
            .alias("status"),
        )
    )
