"""A crawl that goes on over many batches: its frontier is a table.

Each batch takes some waiting urls of every root, the nearest ones first, fetches
them and adds the links nobody has seen.  All that a batch decides is written under
its number, so a batch that runs again after a failure replaces what it wrote, and
a crawl that was cut off anywhere goes on as if it had not been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.functions.links import page_links
from webtrawl.operators.ordered import TASK_ROWS, rank_rows
from webtrawl.plans.crawl import MAX_DEPTH
from webtrawl.sources.changes import ChangeTable
from webtrawl.sources.scratch import broadcast_if_small, materialize
from webtrawl.streaming.run import Handler

WAITING, FETCHED, FAILED, UNVISITED = "waiting", "fetched", "failed", "unvisited"

# Urls of a root that a batch fetches.
URLS_OF_A_ROOT = 1_000

FRONTIER = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("state", T.StringType()),
    ]
)


def frontier_table(spark: SparkSession, path: str) -> ChangeTable:
    """The frontier below ``path``, empty."""
    return ChangeTable(spark, path, FRONTIER, ("root", "url")).start()


def crawl_step(
    frontier: ChangeTable,
    seeds: DataFrame,
    pages: DataFrame,
    batch_id: int,
    max_depth: int = MAX_DEPTH,
    urls_of_a_root: int = URLS_OF_A_ROOT,
    task_rows: int = TASK_ROWS,
) -> None:
    """Take the crawl a batch further: ``seeds`` (root) begin, waiting urls are fetched.

    ``pages`` holds (url, hrefs).  Urls of one root are taken by depth, then url, so
    that a url has the depth that a crawl in one go gives it.  A root that was
    begun before is not begun again.
    """
    frontier.snapshot_if_due(batch_id)
    known = materialize(frontier.current(batch_id), "frontier")
    begun = known.select("root").distinct()
    start = F.lit(WAITING if max_depth > 0 else UNVISITED)
    new = (
        seeds.select("root").where(F.col("root").isNotNull()).distinct()
        .join(begun, "root", "left_anti")
        .select("root", F.col("root").alias("url"), F.lit(0).alias("depth"), start.alias("state"))
    )
    new = materialize(new, "seeds")
    waiting = known.unionByName(new).where(F.col("state") == WAITING)
    ranked = rank_rows(waiting, ["root"], ["depth", "url"], "_rank", task_rows)
    taken = materialize(ranked.where(F.col("_rank") <= urls_of_a_root).select("root", "url", "depth"), "taken")

    found = pages.join(broadcast_if_small(taken.select("url").distinct(), "url"), "url", "left_semi")
    found = materialize(found.dropDuplicates(["url"]).select("url", "hrefs"), "found")
    fetched = taken.join(found, "url")
    failed = taken.join(found.select("url"), "url", "left_anti")
    depth = F.col("depth") + 1
    links = (
        fetched.select("root", depth.alias("depth"), F.explode(page_links(F.col("hrefs"), F.col("root"))).alias("url"))
        .groupBy("root", "url")
        .agg(F.min("depth").alias("depth"))
    )
    seen = known.select("root", "url").unionByName(new.select("root", "url"))
    unseen = links.join(seen, ["root", "url"], "left_anti").select(
        "root", "url", "depth",
        F.when(F.col("depth") < max_depth, WAITING).otherwise(UNVISITED).alias("state"),
    )
    begun_only = new.join(taken.select("root", "url"), ["root", "url"], "left_anti")
    changes = (
        fetched.select("root", "url", "depth", F.lit(FETCHED).alias("state"))
        .unionByName(failed.select("root", "url", "depth", F.lit(FAILED).alias("state")))
        .unionByName(unseen)
        .unionByName(begun_only)
    )
    frontier.write(changes, batch_id)


def crawl_handler(
    frontier: ChangeTable, pages: DataFrame, max_depth: int = MAX_DEPTH, urls_of_a_root: int = URLS_OF_A_ROOT
) -> Handler:
    """Handles a batch of (root), null or not: each batch takes the crawl further.

    A stream with rows that name no root, such as a clock, keeps a crawl going
    when no task comes.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        crawl_step(frontier, batch, pages, batch_id, max_depth, urls_of_a_root)

    return handle


def is_done(frontier: ChangeTable) -> bool:
    """Whether no url is waiting."""
    return frontier.current().where(F.col("state") == WAITING).isEmpty()
