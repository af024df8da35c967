"""The trie of conversation openings, built in range shards of padded turn-id matrices.

Conversations are rebuilt, sorted by their turns and dealt to range shards.  In a
shard the turn ids form matrices padded with 0, some columns at a time.  ``lexsort``
orders the rows; a row starts a node of depth d where any of its first d ids
differs from the row above, which an OR accumulated over the columns tells; and
``reduceat`` over these starts sums up every depth.

A node whose conversations lie in several shards holds the first or the last row
of each of them.  Such boundary nodes come out as partial sums under a digest of
their turns, are added up by digest, and then pass their own shares up to their
ancestors, all of which are boundary nodes too.  They are two paths for each shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import broadcast_if_measured, quoted
from webtrawl.operators.ordered import rank_rows
from webtrawl.sources.scratch import materialize

# Turns of a shard, which a task holds whole.
SHARD_TURNS = 200_000

# Columns of a padded matrix; longer conversations go on in further matrices.
WIDTH = 32

# conv_ids of a row of a boundary node's ends.
ENDS = 65_536

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def marked(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, mark, size): turns with a 64-bit id for each role and text.

    The seed of the ids is the first under which no two different turns of the
    table share one, told by a second hash.
    """
    plain = conversations.select(
        quoted("conv_id").cast("bigint").alias("conv"),
        quoted("turn").alias("turn"),
        *[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).where("conv IS NOT NULL")
    seed = 0
    while True:
        found = plain.withColumns(
            {"mark": F.xxhash64(F.lit(seed), "role", "text"), "size": F.char_length("text")}
        )
        other = F.xxhash64(F.lit(-1 - seed), "role", "text")
        shared = found.groupBy("mark").agg((F.min(other) != F.max(other)).alias("shared"))
        if shared.where("shared").isEmpty():
            return found
        seed += 1


def paths(conversations: DataFrame) -> DataFrame:
    """(conv, turns): the turns of each conv_id as (mark, size), by number, null first.

    Turns with one number follow in the order of role and text.  A null role or
    text is empty; rows with a null conv_id are left out.
    """
    turns = marked(conversations)
    tied = turns.groupBy("conv", "turn").agg((F.min("mark") != F.max("mark")).alias("tied"))
    tied = materialize(tied.where("tied").select(F.col("conv").alias("c"), F.col("turn").alias("t")), "tied")
    slim = turns.select("conv", "turn", "mark", "size")
    if tied.isEmpty():
        placed = slim.withColumn("place", F.lit(0).cast("bigint"))
    else:
        same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        ranked = rank_rows(turns.join(tied, same, "left_semi"), ["conv", "turn"], ["role", "text"], "place")
        first = materialize(
            ranked.groupBy(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("mark").alias("m"))
            .agg(F.min("place").alias("place")),
            "places",
        )
        placed = slim.join(first, same & (F.col("mark") == F.col("m")), "left").drop("c", "t", "m")
    ordered = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "place", "mark", "size")
    return placed.groupBy("conv").agg(
        F.transform(F.array_sort(F.collect_list(ordered)), lambda x: F.struct(x["mark"], x["size"])).alias("turns")
    )


def kept_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its hundred."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, marks, sizes): every conversation with the opening of the first of its hundred.

    The first h turns are those of conversation c - c % 100 (as many as there
    are), the others what follows the first h of its own.
    """
    own = materialize(paths(conversations), "paths")
    heads = own.where("pmod(conv, 100) = 0").select(
        F.col("conv").alias("base"), F.slice("turns", 1, 5).alias("head")
    )
    found = own.withColumns(
        {"base": F.col("conv") - F.pmod("conv", F.lit(100)), "h": kept_turns(F.col("conv"))}
    ).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    both = F.coalesce(F.concat(head, rest), rest)
    return found.select("conv", both.alias("turns")).select(
        "conv", F.col("turns.mark").alias("marks"), F.col("turns.size").alias("sizes")
    )


# --- A shard --------------------------------------------------------------------


def _matrix(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """Columns ``at`` to ``at + WIDTH`` of ``rows``, 0 beyond a row's end."""
    columns = at + np.arange(WIDTH)
    inside = columns[None, :] < lengths[rows][:, None]
    found = np.zeros(inside.shape, np.int64)
    found[inside] = ids[(starts[rows][:, None] + columns[None, :])[inside]]
    return found


def sorted_rows(conv: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows in the order of their ids, shorter first, then of conv.

    A matrix at a time: rows that tie on one go on to the next, in the slots they hold.
    """
    order = np.arange(len(conv))
    slots, group, at = order.copy(), np.zeros(len(conv), np.int64), 0
    while len(slots):
        rows = order[slots]
        matrix = _matrix(ids, starts, lengths, rows, at)
        turn = np.lexsort((conv[rows], *matrix.T[::-1], group))
        order[slots] = rows = rows[turn]
        matrix, group = matrix[turn], group[turn]
        new = np.append(True, (group[1:] != group[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1))
        group = np.cumsum(new)
        at += WIDTH
        # A group goes on as a whole, so that a row that ends here comes first.
        longer = np.bincount(group, lengths[rows] > at) > 0
        go_on = (np.bincount(group) > 1) & longer
        slots, group = slots[go_on[group]], group[go_on[group]]
    return order


def node_starts(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1 on: the rows that reach it, and which of them start a node."""
    rows, at = np.arange(len(lengths)), 0
    changed = np.zeros(len(rows), bool)
    while len(rows := rows[(reach := lengths[rows] > at)]):
        matrix = _matrix(ids, starts, lengths, rows, at)
        differs = np.ones(matrix.shape, bool)
        differs[1:] = matrix[1:] != matrix[:-1]
        differs[1:, 0] |= changed[reach][1:] | (np.diff(rows) != 1)
        masks = np.logical_or.accumulate(differs, axis=1)
        for k in range(min(WIDTH, int(lengths[rows].max()) - at)):
            here = lengths[rows] > at + k
            yield rows[here], masks[here, k]
        changed, at = masks[:, -1], at + WIDTH


def _keys(marks: np.ndarray) -> list[bytes]:
    """Digests of the openings of a row, from no turn to all."""
    digest = hashlib.blake2b(digest_size=16)
    found = [digest.digest()]
    for mark in marks:
        digest.update(mark.tobytes())
        found.append(digest.copy().digest())
    return found


def ends_text(convs: np.ndarray) -> bytes:
    return ",".join(map(str, convs.tolist())).encode()


NODES = pa.schema(
    [
        ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()),
        ("ends_sha256", pa.string()), ("first_end", pa.int64()), ("ends", pa.binary()),
    ]
)
NODES_DDL = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string, "
    "first_end bigint, ends binary"
)


def shard_nodes(conv: np.ndarray, marks: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> pa.Table:
    """The nodes of a shard of at least one row.

    A node without key is whole; its parent is given by conv_id, or by key where
    that is a boundary node.  A boundary node comes with what its children that are
    none, and all below these, sum up to, and its ends in rows of their own.
    """
    lengths = np.diff(starts)
    # Ids from 1 on in the order of the marks, as 0 pads.
    ids = np.unique(marks, return_inverse=True)[1].astype(np.int64) + 1
    order = sorted_rows(conv, ids, starts[:-1], lengths)
    conv, begin, lengths = conv[order], starts[:-1][order], lengths[order]
    n = len(conv)
    first_path = _keys(marks[begin[0] : begin[0] + lengths[0]])
    last_path = _keys(marks[begin[-1] : begin[-1] + lengths[-1]])

    levels = [{"first": np.zeros(1, np.int64), "n": np.array([n]), "size": np.zeros(1, np.int64)}]
    for depth, (rows, new) in enumerate(node_starts(ids, begin, lengths), 1):
        at = np.flatnonzero(new)
        first = rows[at]
        levels.append(
            {
                "first": first,
                "n": np.add.reduceat(np.ones(len(rows), np.int64), at),
                "size": sizes[begin[first] + depth - 1].astype(np.int64),
                "conv": np.minimum.reduceat(conv[rows], at),
                "n_ends": np.add.reduceat((lengths[rows] == depth).astype(np.int64), at),
            }
        )
    levels[0] |= {"conv": np.array([conv.min()]), "n_ends": np.array([int((lengths == 0).sum())])}
    for level in levels:
        level["edge"] = (level["first"] == 0) | (level["first"] + level["n"] == n)
        level["saved"] = np.where(level["edge"], 0, (level["n"] - 1) * level["size"])
        level["children"] = np.zeros(len(level["first"]), np.int64)
        level["leaves"] = np.zeros(len(level["first"]), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        level["leaves"] += (level["children"] == 0) & ~level["edge"]
        if depth:
            above = levels[depth - 1]
            level["parent"] = np.searchsorted(above["first"], level["first"], "right") - 1
            # A boundary node passes its sums up when they are complete, in _carried_up.
            inner = ~level["edge"]
            for name, share in (("children", 1), ("leaves", level["leaves"][inner]), ("saved", level["saved"][inner])):
                np.add.at(above[name], level["parent"][inner], share)

    tables = []
    for depth, level in enumerate(levels):
        size = len(level["first"])
        edge = level["edge"]
        key, parent_key, parent_conv = [None] * size, [None] * size, np.zeros(size, np.int64)
        lost = np.ones(size, bool)
        for k in np.flatnonzero(edge):
            key[k] = (first_path if level["first"][k] == 0 else last_path)[depth]
        if depth:
            above = levels[depth - 1]
            parent_conv = above["conv"][level["parent"]]
            lost = above["edge"][level["parent"]]
            for k in np.flatnonzero(lost):
                parent_key[k] = above["key"][level["parent"][k]]
        level["key"] = key
        shas, ends = [None] * size, []
        for k in range(size):
            own = conv[level["first"][k] : level["first"][k] + level["n_ends"][k]]
            if not edge[k]:
                shas[k] = hashlib.sha256(ends_text(own)).hexdigest() if len(own) else EMPTY_SHA256
            else:
                ends += [(key[k], own[j : j + ENDS]) for j in range(0, len(own), ENDS)]
        nothing = pa.nulls(size, pa.int64())
        tables.append(
            pa.table(
                [
                    pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(level["conv"]),
                    pa.array(np.full(size, depth)), pa.array(parent_conv, mask=lost), pa.array(level["n"]),
                    pa.array(level["children"]), pa.array(level["leaves"]), pa.array(level["saved"]),
                    pa.array(level["size"]), pa.array(shas, pa.string()), nothing, pa.nulls(size, pa.binary()),
                ],
                schema=NODES,
            )
        )
        if ends:
            rows = [{"key": k, "first_end": int(c[0]), "ends": c.astype("<i8").tobytes()} for k, c in ends]
            tables.append(pa.Table.from_pylist(rows, NODES))
    return pa.concat_tables(tables)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition, which is one shard."""
    found = [b for b in batches if len(b)]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    conv = table.column("conv").to_numpy()
    marks, sizes = (table.column(c).combine_chunks() for c in ("marks", "sizes"))
    if isinstance(marks, pa.ChunkedArray):
        marks, sizes = marks.chunk(0), sizes.chunk(0)
    lengths = marks.value_lengths().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    yield from shard_nodes(
        conv, marks.flatten().to_numpy(), sizes.flatten().to_numpy(), starts
    ).to_batches(max_chunksize=50_000)


# --- Boundary nodes -------------------------------------------------------------


def _carried_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes with their own shares added to themselves and to all above them.

    All boundary nodes: two paths of each shard at most.
    """
    rows = [row for batch in batches for row in batch.to_pylist()]
    known = {row["key"]: row for row in rows}
    children: dict[bytes, int] = {}
    for row in rows:
        children[row["parent_key"]] = children.get(row["parent_key"], 0) + 1
    for row in sorted(rows, key=lambda r: -r["depth"]):
        row["n_children"] += children.get(row["key"], 0)
        row["n_leaves"] += row["n_children"] == 0
        row["saved_tokens"] += (row["n_convs"] - 1) * row["size"]
        above = known.get(row["parent_key"])
        row["parent_conv_id"] = above["conv_id"] if above else None
        if above:
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    schema = pa.schema([f for f in NODES if f.name not in ("ends_sha256", "first_end", "ends", "size")])
    yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema} for r in rows], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key, over its conv_ids in order; a row of them at a time is held."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    done.append({"key": key, "ends_sha256": digest.hexdigest()})
                key, digest = row["key"], hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends_text(np.frombuffer(row["ends"], "<i8")))
        yield pa.RecordBatch.from_pylist(done, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": digest.hexdigest()}], schema)


def nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct opening of rebuilt conversations, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).  A rebuilt conversation is a row of ids, and a shard holds about
    ``shard_turns`` turns; rows of one opening, however common, lie in several
    shards.  The ends of a boundary node pass through one task as a stream, as
    SHA-256 reads them in order.  Without conversations there is no node.
    """
    spark = conversations.sparkSession
    rows = materialize(rebuilt(conversations), "rebuilt")
    turns = rows.agg(F.sum(F.size("marks"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / shard_turns))
    found = materialize(
        rows.repartitionByRange(shards, "marks", "conv").mapInArrow(_shards, NODES_DDL), "nodes"
    )
    shared = (
        found.where("key IS NOT NULL AND conv_id IS NOT NULL")
        .groupBy("key", "parent_key", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.max("size").alias("size"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    kinds = "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint"
    shared = materialize(
        shared.coalesce(1).mapInArrow(_carried_up, f"{kinds}, n_children bigint, n_leaves bigint, saved_tokens bigint"),
        "boundary",
    )
    ends = (
        found.where("ends IS NOT NULL").select("key", "first_end", "ends")
        .repartition("key").sortWithinPartitions("key", "first_end")
        .mapInArrow(_digests, "key binary, ends_sha256 string")
    )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    boundary = shared.join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))
    )
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("at_boundary"))
    whole = found.where("key IS NULL")
    inside = whole.where("parent_key IS NULL")
    below = (
        whole.where("parent_key IS NOT NULL")
        .join(broadcast_if_measured(parents), "parent_key")
        .withColumn("parent_conv_id", F.col("at_boundary"))
    )
    return inside.select(*names).unionByName(below.select(*names)).unionByName(boundary.select(*names))
