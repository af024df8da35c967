"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.sources.scratch import materialize


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another; the root is the smallest of its component.

    Alternating large and small stars: every round hangs each node's larger
    neighbours, then its smaller ones, on its smallest neighbour, until only
    stars are left.  A round has no more rows than links and nodes, and none of
    it is gathered by node, so a node with many links needs no large task.
    """
    edges = materialize(
        links.select(F.greatest(left, right).alias("node"), F.least(left, right).alias("root"))
        .where("node != root")
        .distinct(),
        "edges",
    )
    while not _are_stars(edges):
        edges = materialize(_small_star(_large_star(edges)), "edges")
    return edges


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root only, and no root hangs on another."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("node").alias("end"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                F.struct(F.col("root").alias("end"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
            )
        ).alias("e")
    )
    sums = ends.groupBy("e.end").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
    return sums.where("hangs + holds > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    # Written out, so that the join may split the links of one node over tasks.
    least = materialize(both.groupBy("node").agg(F.min("root").alias("least")), "least")
    return (
        both.join(least, "node")
        .where("root > node")
        .select(F.col("root").alias("node"), F.least("least", "node").alias("root"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("node").agg(F.min("root").alias("least")), "least")
    hung = edges.join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return (
        hung.where("node != root")
        .unionByName(least.select("node", F.col("least").alias("root")))
        .distinct()
    )
