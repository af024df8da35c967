"""Lines repeated over many sites, found by sketches of their sites.

Each line hash gets a HyperLogLog sketch of the sites it occurs on, merged by
aggregation.  A line whose estimate lies clearly above or below the threshold is
decided by it; lines near the threshold get an exact count of their sites.  Lines
on enough sites are boilerplate and are removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import broadcast_if_measured, empty_if_null, quoted, row_key
from webtrawl.sources.scratch import materialize

# A line on so many sites is boilerplate.
SITES = 8

# 2 ** 10 registers: a relative standard error of 3.3 percent.
LOG_REGISTERS = 10

# Estimates within this share of the threshold are counted exactly, seven
# standard errors to either side.
NEAR = 0.25

BLANKS = "\t\n\x0b\x0c\r "

# How ``marks`` has a line that goes.
REMOVED = b"1"


def line_hash(line: Column) -> Column:
    """128 bits of a line without the blanks around it; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    key = F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b"))
    return F.when(bare != "", key)


def lines_of(docs: DataFrame) -> DataFrame:
    """(mark, site, at, line) for each line that is not blank, of (mark, site, text) rows."""
    split = docs.select("mark", "site", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return split.select("mark", "site", "at", line_hash(F.col("text")).alias("line")).where(
        "line is not null"
    )


def spread(lines: DataFrame, sites: int = SITES, near: float = NEAR) -> DataFrame:
    """(line) for the lines that occur on ``sites`` or more sites; a null site is one of its own."""
    site = F.xxhash64("site", F.col("site").isNull())
    sketches = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(site, LOG_REGISTERS)).alias("estimate")
    )
    low, high = sites * (1 - near), sites * (1 + near)
    estimated = materialize(sketches.where(F.col("estimate") >= low), "spread")
    unsure = estimated.where(F.col("estimate") <= high).select("line")
    counted = (
        lines.select("line", site.alias("site"))
        .join(unsure, "line", "left_semi")
        .distinct()
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= sites)
    )
    return estimated.where(F.col("estimate") > high).select("line").unionByName(counted.select("line"))


def marks(at: Column) -> Column:
    """A byte for each line up to the last of ``at``, which is in order: 1 for those in it.

    A byte of a binary value is found in one step, so a document is cleaned in
    time in proportion to its lines, however many of them go.
    """
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    step = lambda a, b: F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1"))
    return F.array_join(F.zip_with(before, at, step), "").cast("binary")


def clean(
    docs: DataFrame,
    doc_id: str = "doc_id",
    site: str = "source",
    text: str = "text",
    sites: int = SITES,
) -> DataFrame:
    """``docs`` with n_lines, n_removed and clean_text: the text without boilerplate lines.

    Blank lines are neither counted for their spread nor removed.  A null text is
    empty, and stays null in ``clean_text`` being empty; rows that repeat are all
    cleaned.  Columns of these three names are replaced.
    """
    mark = row_key(quoted(doc_id), quoted(text))
    slim = docs.select(
        mark.alias("mark"),
        quoted(site).cast("string").alias("site"),
        empty_if_null(quoted(text)).alias("text"),
    )
    # Read three times below: hashes and places, no text.
    lines = materialize(lines_of(slim), "lines")
    boilerplate = materialize(spread(lines, sites), "boilerplate")
    # A document's lines to remove, marked up to the last one; rows that repeat share it.
    # While the marks of all documents fit a broadcast, no text moves.
    places = materialize(
        lines.select("mark", "at", "line")
        .join(boilerplate, "line", "left_semi")
        .groupBy("mark")
        .agg(F.array_sort(F.collect_set("at")).alias("at"))
        .select("mark", F.size("at").alias("n"), marks(F.col("at")).alias("marks")),
        "places",
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed", "clean_text")]
    pieces = F.split(empty_if_null(F.col("row")[text]), "\n")
    stays = lambda line, k: F.coalesce(F.substring("marks", k + 1, F.lit(1)) != F.lit(REMOVED), F.lit(True))
    kept = F.filter("pieces", stays)
    return (
        docs.select(mark.alias("mark"), F.struct("*").alias("row"))
        .join(broadcast_if_measured(places), "mark", "left")
        .select("row", pieces.alias("pieces"), "n", "marks")
        .select(
            *[F.col("row")[c].alias(c) for c in rest],
            F.size("pieces").cast("bigint").alias("n_lines"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"),
            F.array_join(kept, "\n").alias("clean_text"),
        )
    )
