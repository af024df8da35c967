"""Pages come from a snapshot: a fetch is a join on the url."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.sources.scratch import broadcast_if_small, materialize


def spread(pages: DataFrame) -> DataFrame:
    """Give every core some pages when a compact file would make a task or two of them.

    Parsing pages is heavy work on few bytes.  A large input has more splits
    than there are cores and is left alone, so nothing large moves here.
    ``pages`` must be a plain scan: to count the splits of a join is to run it.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def outdated_versions(versions: DataFrame, version: str, key: str = "url") -> DataFrame:
    """The (url, version) pairs that a newer version replaces; reads only these columns."""
    narrow = versions.select(key, version)
    repeated = (
        narrow.groupBy(key)
        .agg(F.max(version).alias("_newest"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    stale = narrow.join(repeated, key).where(F.col(version) < F.col("_newest"))
    return materialize(stale.select(key, version), "outdated")


def drop_versions(pages: DataFrame, outdated: DataFrame, version: str, key: str = "url") -> DataFrame:
    """``pages`` without the outdated pairs.

    These are mostly few, and then the wide rows are filtered where they lie;
    otherwise both sides meet on (url, version), which no hot url can skew.
    """
    return pages.join(broadcast_if_small(outdated, key), [key, version], "left_anti")


def newest_versions(pages: DataFrame, version: str, key: str = "url") -> DataFrame:
    """The newest version of each url; of several rows of it, the greatest."""
    newest = drop_versions(pages, outdated_versions(pages, version, key), version, key)
    return one_of_equal_versions(newest, pages, version, key).select(*pages.columns)


def one_of_equal_versions(
    newest: DataFrame, pages: DataFrame, version: str, key: str = "url"
) -> DataFrame:
    """``newest`` with one row for each url: where its version comes twice, the greatest row.

    Repeats are found on the two narrow columns of ``pages``; other rows stay in place.
    """
    repeated = materialize(
        pages.groupBy(key, version).count().where(F.col("count") > 1).select(key, version), "repeated"
    )
    few = broadcast_if_small(repeated, key)
    row = F.struct(*newest.columns)
    chosen = (
        newest.join(few, [key, version], "left_semi")
        .groupBy(key)
        .agg(F.max(row).alias("_row"))
        .select("_row.*")
    )
    return newest.join(few, [key, version], "left_anti").unionByName(chosen.select(*newest.columns))


def fetch(
    frontier: DataFrame, pages: DataFrame, keep: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The frontier rows found in the snapshot, with its columns, and those that failed."""
    wanted = pages if keep is None else pages.select("url", *keep)
    fetched = frontier.join(wanted, "url")
    failed = frontier.join(pages.select("url"), "url", "left_anti")
    return fetched, failed
