"""Crawl tasks as they come: route, crawl, index, and keep the stat table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.functions.html import page_hrefs, page_text
from webtrawl.operators.tasks import CRAWLING, route_tasks
from webtrawl.plans.crawl import MAX_DEPTH, crawl
from webtrawl.schemas import CRAWLER_STATS, DOCUMENTS
from webtrawl.sources.changes import ChangeTable
from webtrawl.sources.messages import parse_messages, split_malformed, task_fields
from webtrawl.sources.scratch import broadcast_if_small, materialize
from webtrawl.streaming.run import Handler

STAT_KEY = ("domain", "author_id")
MEASURES = {"avg": F.avg, "max": F.max, "min": F.min}
MALFORMED = T.StructType(
    [T.StructField("correlation_id", T.StringType()), T.StructField("body", T.StringType())]
)


@dataclass(frozen=True)
class CrawlTables:
    """The tables a task stream keeps below one folder."""

    stats: ChangeTable
    documents: ChangeTable
    malformed: ChangeTable

    @classmethod
    def below(cls, spark, path: str) -> CrawlTables:
        return cls(
            ChangeTable(spark, f"{path}/stats", CRAWLER_STATS.schema, STAT_KEY),
            ChangeTable(spark, f"{path}/documents", DOCUMENTS, ("url",)),
            ChangeTable(spark, f"{path}/malformed", MALFORMED),
        )

    def start(self, stats: DataFrame | None = None) -> CrawlTables:
        self.stats.start(stats)
        self.documents.start()
        self.malformed.start()
        return self


def task_handler(tables: CrawlTables, pages: DataFrame, max_depth: int = MAX_DEPTH) -> Handler:
    """Handles a batch of task messages against the page snapshot (url, html).

    Where the snapshot has a ``duration`` for its pages, the stats get their
    mean, greatest and least.

    The batch is as late as its newest message.  Its new roots are crawled
    together; their pages go to the documents, their counts to the stats.  The
    links are taken out of the pages once, here, so that a crawl reads no html.
    """
    timed = pages.select("url", "duration") if "duration" in pages.columns else None
    linked = materialize(pages.select("url", page_hrefs(F.col("html")).alias("hrefs")), "links")

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables.stats.snapshot_if_due(batch_id)
        parsed = materialize(parse_messages(batch), "messages")
        good, bad = split_malformed(parsed)
        tables.malformed.write(bad.select("correlation_id", "body"), batch_id)
        tasks = good.select(
            F.col("correlation_id").alias("task_id"),
            *task_fields(),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
        )

        as_of = F.lit(tasks.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp_ntz")
        routed = materialize(
            route_tasks(tasks, tables.stats.current(batch_id), as_of).where(F.col("action") != "skip"),
            "routed",
        )
        roots = routed.where(F.col("action") == "crawl").select(F.col("domain").alias("root"))
        reached = materialize(crawl(roots, linked, max_depth), "reached")
        fetched = reached.where(F.col("state") == "fetched")

        urls = materialize(fetched.select("url").distinct(), "urls")
        content = page_text(F.col("html"), decode=True).alias("content")
        found = pages.join(broadcast_if_small(urls, "url"), "url").select("url", content)
        tables.documents.write(found, batch_id)

        took = F.col("duration") if timed is not None else F.lit(None).cast("double")
        visits = fetched if timed is None else fetched.join(timed, "url")
        counts = (
            roots.distinct()
            .join(visits, "root", "left")
            .groupBy(F.col("root").alias("domain"))
            .agg(
                F.count("url").alias("_pages"),
                *[f(took).cast("double").alias(f"_{m}") for m, f in MEASURES.items()],
            )
            .withColumn("_now", F.lit(True))
        )
        crawls = F.col("action") == "crawl"
        stats = routed.join(counts, "domain", "left").select(
            "domain",
            # All that could be fetched has been, in this very batch; a copy of an
            # older crawl keeps the status it found.
            F.when(F.col("_now") & (F.col("status") == CRAWLING), "Done")
            .otherwise(F.col("status"))
            .alias("status"),
            "author_id",
            "https",
            as_of.alias("time"),
            F.when(crawls, F.coalesce("_pages", F.lit(0)))
            .otherwise(F.col("pages_count"))
            .alias("pages_count"),
            *[F.when(crawls, F.col(f"_{m}")).alias(f"{m}_time_per_page") for m in MEASURES],
            F.when(F.col("_now"), as_of).otherwise(F.col("crawled_at")).alias("crawled_at"),
        )
        tables.stats.write(stats, batch_id)

    return handle


def page_counts_stream(fetches: DataFrame) -> DataFrame:
    """Running pages of each root; for update mode.  Combined before the state is touched."""
    return fetches.groupBy("root").agg(F.count(F.lit(1)).alias("pages_count"))


def unseen_stream(links: DataFrame, within: str | None = None) -> DataFrame:
    """Each (root, url) once.

    Without ``within`` this is exact and its state grows with the urls.  With it,
    ``links`` needs an event time ``ts``, and a url may come back after that long.
    """
    if within is None:
        return links.dropDuplicates(["root", "url"])
    return links.withWatermark("ts", within).dropDuplicatesWithinWatermark(["root", "url"])


def unseen_handler(seen: ChangeTable) -> Handler:
    """Writes the (root, url) pairs of a batch that no batch before had.

    The exact form for links with very common targets: repeats within a batch
    are combined before anything moves, and the known pairs lie in a table
    instead of a state store.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        pairs = batch.select("root", "url").distinct()
        seen.write(pairs.join(seen.rows(batch_id), ["root", "url"], "left_anti"), batch_id)

    return handle
