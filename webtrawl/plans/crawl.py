"""Crawl expansion: from roots, hop by hop, over a page snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.links import page_links
from webtrawl.sources.scratch import broadcast_if_small, materialize

# Fixed value: pages at depth 0, 1 and 2 are fetched.
MAX_DEPTH = 3


def new_links(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """(root, url) pairs linked from ``fetched`` (root, hrefs) and not in ``seen``, once each."""
    links = page_links(F.col("hrefs"), F.col("root"))
    return (
        fetched.select("root", F.explode(links).alias("url"))
        .distinct()
        .join(seen.select("root", "url"), ["root", "url"], "left_anti")
    )


def crawl(
    seeds: DataFrame, pages: DataFrame, max_depth: int = MAX_DEPTH, refetch_root: bool = False
) -> DataFrame:
    """(root, url, depth, state) of every url reached from the roots in ``seeds``.

    A root is where its crawl starts, unless ``seeds`` has a ``url`` for it.

    ``pages`` holds (url, hrefs).  ``state`` is ``fetched``, ``failed`` for a url
    the snapshot lacks, or ``unvisited`` at the depth where fetching stops.

    All roots move together, one round for each depth.  New urls are written
    after each round, so plans stay short and a lost executor costs no rerun of
    earlier rounds.  Keys are (root, url) pairs, which one huge root does not
    skew.  The page table moves only when the frontier is too large to broadcast.

    With ``refetch_root`` a root that is linked to is fetched a second time.
    """
    start = F.col("url") if "url" in seeds.columns else F.col("root").alias("url")
    hop = materialize(seeds.select("root", start).distinct(), "hop-0")
    hops = [hop.withColumn("depth", F.lit(0))]
    seen = hop.limit(0) if refetch_root else hop
    for depth in range(1, max_depth + 1):
        fetched = pages.join(broadcast_if_small(hop, "url"), "url").select("root", "hrefs")
        hop = materialize(new_links(fetched, seen), f"hop-{depth}")
        seen = seen.unionByName(hop)
        hops.append(hop.withColumn("depth", F.lit(depth)))
    reached = reduce(DataFrame.unionByName, hops)
    urls = broadcast_if_small(reached.select("url"), "url")
    known = pages.select("url").join(urls, "url", "left_semi").distinct()
    known = known.withColumn("_known", F.lit(True))
    state = (
        F.when(F.col("depth") == max_depth, "unvisited")
        .when(F.col("_known"), "fetched")
        .otherwise("failed")
    )
    return reached.join(known, "url", "left").select("root", "url", "depth", state.alias("state"))
