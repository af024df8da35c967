"""Ordered work inside groups that may be far larger than one task.

Each function first counts its largest group.  While that fits a task, a plain
window is the cheapest plan: one shuffle on the key.  Otherwise the rows are
range-partitioned on key *and* order, so that one key spreads over many tasks,
and small per-piece summaries carry the running values across the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.functions.times import floor_div
from webtrawl.sources.scratch import materialize

# Rows of one group that a single task sorts without trouble.
TASK_ROWS = 1_000_000

_ROW_BITS = (1 << 33) - 1


def has_large_group(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> bool:
    """Whether some group exceeds ``task_rows``; reads only the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) > task_rows


def _attach(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, matched on ``names``; nulls match too."""
    renamed = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names])
    return left.join(renamed, same, how).drop(*[f"_of_{n}" for n in names])


def _placed(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """``df`` in total order, each row with its range piece and its place there.

    Written out, because the pieces depend on sampled bounds: every later step
    must see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(
        ranged.withColumns(
            {
                "_piece": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
            }
        ),
        label,
    )


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str, after: int = 0
) -> DataFrame:
    """Dense numbers ``after + 1, after + 2, …`` over the whole of ``df``, in ``order``."""
    placed = _placed(df, order, "numbered")
    # One row for each range piece: the unpartitioned window and the broadcast
    # are bounded by the number of shuffle partitions, not by the data.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(pieces), "_piece")
        .withColumn(name, F.lit(after) + F.col("_before") + F.col("_place") + 1)
        .drop("_piece", "_place", "_before")
    )


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    task_rows: int = TASK_ROWS,
    large: bool | None = None,
) -> DataFrame:
    """1-based position of each row within its group; ``order`` must be total.

    ``large`` tells whether some group exceeds a task, where that is known.
    """
    if large is None:
        large = has_large_group(df, keys, task_rows)
    if not large:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))

    placed = _placed(df, [*keys, *order], "ranked")
    before = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    rank = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return _attach(placed, pieces, [*keys, "_piece"]).select(
        *df.columns, rank.cast("bigint").alias(name)
    )


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``value`` of the following row of the group, null on the last one."""
    if not has_large_group(df, keys, task_rows):
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))

    ranked = materialize(rank_rows(df, keys, order, "_rank", large=True), "next")
    following = ranked.select(*keys, (F.col("_rank") - 1).alias("_rank"), F.col(value).alias(name))
    # (key, rank) is unique, so the join is even however large one key is.
    return _attach(ranked, following, [*keys, "_rank"], "left").select(*df.columns, name)


def nearest_following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The first value that is not null on a row or after it in its group, else null.

    Read backwards, that is the last value met so far, so a window passes once
    over each group.  Of a large group, each range piece hands its first value
    to the pieces before it.
    """
    backwards = [F.desc(c) for c in order]
    met = F.last(value, ignorenulls=True)
    if not has_large_group(df, keys, task_rows):
        so_far = Window.partitionBy(*keys).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, met.over(so_far))

    placed = _placed(df, [*keys, *order], "following")
    here = (
        Window.partitionBy(*keys, "_piece").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(value).isNotNull()
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.min_by(F.when(known, F.col(value)), F.when(known, F.col("_place"))).alias("_first"))
        .withColumn("_carry", F.last("_first", ignorenulls=True).over(later))
        .drop("_first")
    )
    local = placed.withColumn("_here", met.over(here))
    return _attach(local, pieces, [*keys, "_piece"]).select(
        *df.columns, F.coalesce("_here", "_carry").alias(name)
    )


def running_max(
    df: DataFrame, keys: Sequence[str], index: str, value: str, name: str, piece_rows: int
) -> DataFrame:
    """Maximum of ``value`` up to each row of a group, by a dense 0-based ``index``.

    The index cuts each group into pieces of exactly ``piece_rows``; the pieces'
    maxima are carried over.  Both sides of the join are partitioned alike, so
    the rows move once.
    """
    cut = df.withColumn("_piece", floor_div(F.col(index), piece_rows))
    within = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(index)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.withColumn("_local", F.max(value).over(within))
    before = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = (
        cut.groupBy(*keys, "_piece")
        .agg(F.max(value).alias("_max"))
        .withColumn("_carry", F.max("_max").over(before))
    )
    return _attach(local, pieces, [*keys, "_piece"]).select(
        *df.columns, F.greatest("_local", "_carry").alias(name)
    )
