"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is counted in blocks of equal numbers of words.  Blocks go to sources by
highest quotients of their targets, then within each source to its shards by
highest quotients of their sizes, which gives an integer quota for every shard.
A shard puts its documents into a seeded order, cuts their words into blocks, and
takes each block as often as the quota goes round, and seeded blocks for the rest.
Where documents must stay whole, the shard rounds what it takes of them up or down
so that their words together stay what they were.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, orderable, quoted, row_key
from webtrawl.operators.ordered import TASK_ROWS, rank_rows
from webtrawl.sources.scratch import materialize

# Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)

# No source, and so no document, is taken more often than this.
MOST_TIMES = 3

# Words of a shard, which one task puts in order: narrow rows, one for a document.
# The shards of a source, one row each, are dealt their blocks in one task; a
# source of more words than these make has larger shards.
SHARD_WORDS = 250_000
MOST_SHARDS = 65_536

# A block has at most so many words, and the smallest target at least so many blocks.
MOST_BLOCK_WORDS = 1_024
LEAST_BLOCKS = 512

SEED = 20


def word_count(text: str | Column = "text") -> Column:
    """Number of runs of characters other than space and tab to carriage return; null has none."""
    return F.regexp_count(empty_if_null(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(
    sizes: Sequence[int], weights: Sequence[int], total: int, most_times: int = MOST_TIMES
) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most_times`` its size.

    What a source cannot take is shared by weight among the others, until none
    is above.  With every source full the rest is left.
    """
    limit = [Fraction(most_times * s) for s in sizes]
    share: list[Fraction | None] = [None] * len(sizes)
    left = Fraction(total)
    while open_ := [k for k, s in enumerate(share) if s is None]:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit > limit[k]]
        for k in full or open_:
            share[k] = limit[k] if full else weights[k] * unit
            left -= share[k]
    return share


def apportion(votes: Sequence[Fraction | int], seats: int) -> list[int]:
    """Sainte-Laguë: ``seats`` go to the highest quotients votes / 1, / 3, / 5, …

    Equal quotients go to the earlier one.  A divisor that gives too few seats,
    by less than one each, stands for the first rounds.
    """
    given = [0] * len(votes)
    total = sum(votes)
    if not total or seats <= 0:
        return given
    active = sum(v > 0 for v in votes)
    if 2 * seats > active:
        divisor = Fraction(total) / (2 * seats - active)
        given = [int((v / divisor + 1) / 2) if v else 0 for v in votes]
    heap = [(-Fraction(v) / (2 * given[k] + 1), k) for k, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, k = heap[0]
        given[k] += 1
        heapq.heapreplace(heap, (-Fraction(votes[k]) / (2 * given[k] + 1), k))
    return given


def block_words(shares: Sequence[Fraction]) -> int:
    """Words of a block, small enough for every source to come near its target."""
    least = min((s for s in shares if s > 0), default=Fraction(1))
    return max(1, min(MOST_BLOCK_WORDS, int(least / LEAST_BLOCKS)))


def take_blocks(sizes: np.ndarray, quota: int, block: int, most_times: int, seed: int) -> np.ndarray:
    """Words taken of each document of a shard, whose documents come in seeded order.

    The shard is cut into blocks whose sizes differ by one word at most.
    """
    ends = np.cumsum(sizes)
    words = int(ends[-1])
    blocks = max(1, round(words / block))
    rounds, rest = divmod(min(quota, most_times * blocks), blocks)
    times = np.full(blocks, rounds, np.int64)
    times[np.random.default_rng(seed).permutation(blocks)[:rest]] += 1
    edges = np.arange(blocks + 1) * words // blocks
    taken = np.concatenate([[0], np.cumsum(times * np.diff(edges))])
    at = np.concatenate([[0], ends])
    inside = np.minimum(np.searchsorted(edges, at, "right") - 1, blocks - 1)
    return np.diff(taken[inside] + times[inside] * (at - edges[inside]))


def whole_copies(sizes: np.ndarray, words: np.ndarray, seed: int) -> np.ndarray:
    """Copies of each document that stand for ``words`` of it: words / size, rounded up or down.

    Two documents at a time move their fractions against each other, word for word
    and by chance, until one of them is whole; long documents come first.  Each one
    keeps its fraction as its expectation, and the words of all differ from the
    sum of ``words`` by less than the size of the one document left to round alone.
    """
    copies, over = np.divmod(words, sizes)
    size, part = sizes.tolist(), over.tolist()
    chance = np.random.default_rng(seed).random(len(size) + 1).tolist()
    left = None
    for k in np.argsort(-sizes, kind="stable").tolist():
        if not part[k]:
            continue
        if left is None:
            left = k
            continue
        up = min(size[left] - part[left], part[k])
        down = min(part[left], size[k] - part[k])
        move = up if chance[k] * (up + down) < down else -down
        part[left] += move
        part[k] -= move
        left = next((i for i in (left, k) if 0 < part[i] < size[i]), None)
    if left is not None:
        part[left] = size[left] if chance[-1] * size[left] < part[left] else 0
    return copies + np.array(part, np.int64) // sizes


def plan(sizes: DataFrame, weights: Sequence[int], most_times: int) -> list[dict]:
    """One entry for each source, in order: its words, target and blocks.

    The sources are held on the driver: one short entry for each.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    rows = sorted(totals.collect(), key=lambda r: (r.source is None, r.source or ""))
    words = [r.words for r in rows]
    shares = targets(words, [weights[k % len(weights)] for k in range(len(rows))], sum(words), most_times)
    block = block_words(shares)
    seats = apportion(shares, round(sum(shares, Fraction(0)) / block))
    return [
        {"source": r.source, "source_size": r.words, "target": float(s), "seats": n, "block": block}
        for r, s, n in zip(rows, shares, seats, strict=True)
    ]


PLAN = "source string, source_size bigint, target double, seats bigint, block bigint"


def shares(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    most_times: int = MOST_TIMES,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    whole: bool = False,
) -> DataFrame:
    """(k0…, source, size, text_key, copies, words, source_size, target): words the mix takes.

    One row for each distinct ``keep`` (k0…), source and text, with the number of
    its copies and the words taken of all of them; if ``whole``, as many as whole
    documents have.
    """
    named = [quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keys = [f"k{i}" for i in range(len(keep))]
    sizes = docs.select(
        *named,
        quoted(source).cast("string").alias("source"),
        word_count(quoted(text)).alias("size"),
        row_key(quoted(text)).alias("text_key"),
    )
    # Equal rows become one with a count, so that none outgrows its shard.
    unit = [*keys, "source", "size", "text_key"]
    units = materialize(sizes.groupBy(*unit).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    spark = docs.sparkSession
    sources = spark.createDataFrame(plan(units, weights, most_times), PLAN)
    sources = sources.withColumnRenamed("source", "of").withColumn("empty", F.col("of").isNull())

    def with_source(rows: DataFrame) -> DataFrame:
        name = F.coalesce("source", F.lit(""))
        same = (name == F.coalesce("of", F.lit(""))) & (F.col("source").isNull() == F.col("empty"))
        return rows.join(sources, same).drop("of", "empty")

    shards = F.least(
        F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    )
    order = F.xxhash64(F.lit(seed), *keys, "size", "text_key")
    placed = with_source(units.where("size > 0")).withColumns(
        {"order": order, "shard": F.pmod(F.xxhash64(F.lit(seed + 1), "order"), shards)}
    )
    quotas = (
        placed.groupBy("source", "shard", "seats", "block")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        .groupBy("source")
        .applyInPandas(_quotas, "source string, shard bigint, quota bigint, block bigint")
    )
    quotas = quotas.select(F.struct("source", "shard").alias("group"), "quota", "block")
    types = ", ".join(f"{c} {units.schema[c].dataType.simpleString()}" for c in unit)
    shuffled = (
        placed.drop("block")
        .withColumn("group", F.struct("source", "shard"))
        .join(quotas.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
        .withColumn("seed", F.xxhash64(F.lit(seed + 2), "group"))
    )

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", *keys], kind="stable", ignore_index=True)
        sizes = frame["size"].to_numpy(np.int64)
        sums = sizes * frame["copies"].to_numpy(np.int64)
        first = frame.iloc[0]
        own = int(first.seed) % (1 << 63)
        words = take_blocks(sums, int(first.quota), int(first.block), most_times, own)
        frame["words"] = whole_copies(sizes, words, own + 1) * sizes if whole else words
        return frame[[*unit, "copies", "words"]]

    sent = [*unit, "copies", "order", "quota", "block", "seed"]
    taken = (
        shuffled.select("group", *sent)
        .groupBy("group")
        .applyInPandas(lambda frame: take(frame), f"{types}, copies bigint, words bigint")
    )
    empty = units.where("size = 0").withColumn("words", F.lit(0).cast("bigint"))
    return with_source(taken.unionByName(empty.select(*taken.columns))).drop("seats", "block")


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    **how,
) -> DataFrame:
    """(keep…, source, text_key, size, source_size, target, taken): words the mix takes of each row.

    Rows equal in ``keep``, source and text share what their words get evenly.
    Texts without words, null ones among them, are taken 0 times.  The result
    depends on the rows and the seed alone, not on where they lie.
    """
    rows = shares(docs, source, text, keep, **how).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    )
    return rows.withColumn("taken", _even("words")).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "source",
        "text_key",
        "size",
        "source_size",
        "target",
        "taken",
    )


def _even(amount: str) -> Column:
    """What row number ``copy`` of ``copies`` gets of an amount that they share evenly."""
    more = F.col("copy") <= F.col(amount) % F.col("copies")
    return F.floor(F.col(amount) / F.col("copies")) + more.cast("bigint")


def resample(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    task_rows: int = TASK_ROWS,
    **how,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in whole documents.

    A row's number is what the mix takes of its words by its size, rounded up or
    down so that the words of each shard stay what the mix takes, to less than one
    document.  Texts without words are left out.
    """
    slim = docs.select(
        quoted(doc_id).alias("id"), quoted(source).alias("source"), quoted(text).alias("text")
    )
    mark = F.struct(F.col("k0").alias("id"), "source", F.col("text_key").alias("key")).alias("mark")
    times = materialize(
        shares(slim, keep=["id"], whole=True, **how)
        .where("words > 0")
        .select(mark, "copies", F.expr("words div size").alias("times")),
        "times",
    )
    own = F.struct(
        quoted(doc_id).alias("id"),
        quoted(source).cast("string").alias("source"),
        row_key(quoted(text)).alias("key"),
    )
    rows = docs.select(own.alias("mark"), F.struct("*").alias("row"))
    found = rows.join(times.where("copies = 1"), "mark").select("row", "times")
    most = times.agg(F.max("copies")).first()[0] or 0
    if most > 1:
        # Rows that share a mark are numbered by all their columns, and share its copies evenly.
        tie = row_key(*[F.col("row")[c] for c in orderable(docs)])
        shared = rows.join(times.where("copies > 1"), "mark").withColumn("tie", tie)
        numbered = rank_rows(shared, ["mark"], ["tie"], "copy", large=most > task_rows)
        found = found.unionByName(numbered.select("row", _even("times").alias("times")))
    return (
        found.where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
        .select("row.*")
    )


def _quotas(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source, dealt to its shards."""
    frame = frame.sort_values("shard", ignore_index=True)
    frame["quota"] = apportion([int(w) for w in frame["words"]], int(frame["seats"].iloc[0]))
    return frame[["source", "shard", "quota", "block"]]
