"""Vectors that point nearly the same way, by int8 tile products with error bounds.

Equal vectors are merged first and counted.  The distinct ones are laid in blocks
of like direction, and each block is a row of int8 values.  A tile is a pair of
blocks: their int8 values are multiplied as a matrix product, exactly, since sums of
such products fit the mantissa of a float.  What quantisation left out of a vector has a
known length, so each approximate cosine has a rigorous bound: pairs that are
surely links or surely none are settled, and only the others are computed again
in double precision, tile by tile.

A tile emits sums by vector and a spanning forest of its links, never its pairs.
Tiles of blocks whose directions rule out any link are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import quoted, row_key
from webtrawl.operators.components import components
from webtrawl.operators.ordered import number_rows
from webtrawl.sources.scratch import materialize

SIMILARITY = 0.95

# Vectors of a block: a 64th of all, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 2_048, 16_384

# Vectors that blocks gather around; where they lie changes no result.
PIVOTS = 256

# Pairs in question of one row between the two passes.
PAIRS = 1 << 19

# Products that a task holds at a time.
PRODUCTS = 1 << 20

# More than rounding adds to a cosine of float products, or to a double one.
SLACK, TINY = 1e-6, 1e-12

# Dimensions whose int8 products a float sums exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1_024


def usable(vectors: DataFrame, embedding: str = "embedding") -> Column:
    """Whether a vector has a direction: no null, no non-finite component, not all zero.

    A length beyond the range of doubles counts as none.
    """
    column = quoted(embedding)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce(column.isNotNull() & finite & some, F.lit(False))


def distinct_vectors(slim: DataFrame) -> DataFrame:
    """(key, dim, vector, many, least): each distinct vector, how often, its smallest id.

    ``slim`` has id, vector and key of usable vectors.  They are written out for
    the passes that follow.
    """
    merged = slim.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("id").alias("least"), F.any_value("vector").alias("vector")
    )
    return materialize(merged.withColumn("dim", F.size("vector")), "vectors")


def _unit(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """Rows of unit length out of a column of lists of one size."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(len(batch), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def placed(found: DataFrame) -> DataFrame:
    """``found`` with ``cell`` and ``off``: the nearest pivot and one less the cosine to it.

    Pivots are the vectors with the smallest hashes.
    """
    rows = found.orderBy(F.xxhash64("key")).limit(PIVOTS).select("dim", "vector").collect()
    pivots: dict[int, list] = {}
    for r in rows:
        pivots.setdefault(r.dim, []).append(r.vector)
    units = {d: (a := np.array(v, np.float64)) / np.linalg.norm(a, axis=1)[:, None] for d, v in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, off = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, at in _by_size(batch):
                if dim in units:
                    near = _unit(batch.take(pa.array(at))) @ units[dim].T
                    cell[at] = near.argmax(axis=1)
                    off[at] = 1 - near.max(axis=1)
            yield batch.append_column("cell", pa.array(cell)).append_column("off", pa.array(off))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{kinds}, cell int, off double")


# --- Blocks ---------------------------------------------------------------------

BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("dim", pa.int32()), ("first", pa.int64()), ("many", pa.list_(pa.int64())),
        ("q", pa.binary()), ("scale", pa.list_(pa.float64())), ("error", pa.list_(pa.float64())),
        ("unit", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
    ]
)
BLOCKS_DDL = (
    "block bigint, dim int, first bigint, many array<bigint>, q binary, scale array<double>, "
    "error array<double>, unit binary, centre array<double>, radius double"
)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values and scales of unit vectors, and a bound of the length each one lost."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) + TINY


def _block(table: pa.Table) -> pa.Table:
    """One row for the vectors of a block, which are of one size."""
    table = table.sort_by("node").combine_chunks()
    unit = _unit(table.to_batches()[0])
    q, scale, error = quantised(unit)
    centre = unit.mean(axis=0)
    length = np.linalg.norm(centre)
    # A block without a mean direction is as wide as can be.
    centre = centre / length if length > TINY else unit[0]
    radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))
    row = {
        "block": table.column("block")[0].as_py(), "dim": unit.shape[1], "first": table.column("node")[0].as_py(),
        "many": table.column("many").to_pylist(), "q": q.tobytes(), "scale": scale, "error": error,
        "unit": unit.tobytes(), "centre": centre, "radius": radius,
    }
    return pa.Table.from_pylist([row], BLOCKS)


def blocks_of(found: DataFrame, size: int) -> DataFrame:
    """(node, block, …) numbered in the order of size of vector, pivot and nearness to it."""
    ordered = number_rows(placed(found), ["dim", "cell", "off", "key"], "node")
    # Blocks end with a size of vectors, too.
    return materialize(
        ordered.withColumn("block", F.floor(F.col("node") / size) * 65_536 + F.pmod("dim", F.lit(65_536))),
        "placed",
    )


def tiles(blocks: DataFrame, near: float) -> DataFrame:
    """(a, b): pairs of blocks, a <= b, whose directions allow a cosine of ``near``.

    Every vector of a block lies within its radius of its centre, so two blocks
    whose centres are further apart than both radii and the angle of ``near``
    hold no link.  Centres are a row for each block: one for MOST_BLOCK vectors beyond a million.
    """
    heads = blocks.select("block", "dim", "centre", "radius").collect()
    known: dict[int, tuple] = {}
    for dim in {r.dim for r in heads}:
        rows = sorted((r.block, r.centre, r.radius) for r in heads if r.dim == dim)
        known[dim] = tuple(np.array(part) for part in zip(*rows, strict=True))
    reach = math.acos(max(-1.0, min(1.0, near))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, dim in zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                names, centres, radii = known[dim]
                at = int(np.searchsorted(names, a))
                apart = np.arccos(np.clip(centres[at:] @ centres[at], -1, 1))
                b = names[at:][apart <= radii[at:] + radii[at] + reach]
                yield pa.record_batch({"a": pa.array(np.full(len(b), a)), "b": pa.array(b)})

    return blocks.select("block", "dim").repartition("block").mapInArrow(run, "a bigint, b bigint")


# --- Tiles ----------------------------------------------------------------------


class Forest:
    """Which nodes of a tile hang together, fed with links a part at a time."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            differ = a != b
            left, right, a, b = left[differ], right[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(above := self.root[self.root], self.root):
                self.root = above


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    if a.shape[1] <= EXACT:
        return a @ b.T
    parts = range(0, a.shape[1], EXACT)
    return sum((a[:, k : k + EXACT] @ b[:, k : k + EXACT].T).astype(np.float64) for k in parts)


FOUND = pa.schema(
    [
        ("a", pa.int64()), ("b", pa.int64()), ("node", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
        ("root", pa.list_(pa.int64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
    ]
)
FOUND_DDL = (
    "a bigint, b bigint, node array<bigint>, links array<bigint>, root array<bigint>, "
    "`left` array<int>, `right` array<int>"
)


class Tile:
    """Two blocks, or one with itself, and the sums of their links."""

    def __init__(self, table: pa.Table):
        sides = {r["side"]: r for r in table.to_pylist()}
        self.a, self.b = sides[0], sides.get(1, sides[0])
        self.same = 1 not in sides
        self.many = [np.array(s["many"], np.int64) for s in (self.a, self.b)]
        self.sizes = [len(m) for m in self.many]
        self.links = [np.zeros(n, np.int64) for n in self.sizes]
        self.forest = Forest(self.sizes[0] if self.same else sum(self.sizes))

    def matrix(self, side: dict, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(side[name], kind).reshape(-1, side["dim"])

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Count links between places of the two blocks; a copy counts as often as it occurs."""
        np.add.at(self.links[0], left, self.many[1][right])
        np.add.at(self.links[1], right, self.many[0][left])
        self.forest.add(left, right + (0 if self.same else self.sizes[0]))

    def sums(self) -> list[pa.RecordBatch]:
        """One row with the links of each linked vector and the root of its tree, if any are."""
        places = [self.a["first"] + np.arange(self.sizes[0]), self.b["first"] + np.arange(self.sizes[1])]
        if self.same:
            nodes, links = places[0], self.links[0] + self.links[1]
        else:
            nodes, links = np.concatenate(places), np.concatenate(self.links)
        linked, roots = links > 0, nodes[self.forest.root]
        if not linked.any():
            return []
        return [self.row(node=nodes[linked], links=links[linked], root=roots[linked])]

    def row(self, **values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"a": self.a["block"], "b": self.b["block"], **values}], FOUND)


def compared(table: pa.Table, near: float) -> Iterator[pa.RecordBatch]:
    """First pass over a tile: links that are sure, and pairs in question, PAIRS in a row."""
    tile = Tile(table)
    qa, qb = (tile.matrix(s, "q", np.int8).astype(np.float32) for s in (tile.a, tile.b))
    sa, sb = (np.array(s["scale"]) for s in (tile.a, tile.b))
    ea, eb = (np.array(s["error"]) for s in (tile.a, tile.b))
    # Of unit vectors x and y that lost ex and ey, the product lost at most this much.
    loosest = ea.max() + eb.max() + 3 * ea.max() * eb.max() + SLACK
    least = (near - loosest) / sa
    least -= SLACK * (1 + np.abs(least))
    step = max(1, PRODUCTS // len(qb))
    for start in range(0, len(qa), step):
        part = _product(qa[start : start + step], qb)
        part *= sb.astype(part.dtype)
        left, right = np.nonzero(part >= least[start : start + step, None].astype(part.dtype))
        cosine = part[left, right] * sa[start + left]
        left = left + start
        if tile.same:
            upper = left < right
            left, right, cosine = left[upper], right[upper], cosine[upper]
        lost = ea[left] + eb[right] + 3 * ea[left] * eb[right] + SLACK
        sure, open_ = cosine - lost >= near, np.abs(cosine - near) <= lost
        tile.add(left[sure], right[sure])
        left, right = left[open_].astype(np.int32), right[open_].astype(np.int32)
        for k in range(0, len(left), PAIRS):
            yield tile.row(left=left[k : k + PAIRS], right=right[k : k + PAIRS])
    yield from tile.sums()


def settled(sides: pa.Table, asked: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    """Second pass over a tile: its pairs in question in double precision."""
    tile = Tile(sides)
    ua, ub = (tile.matrix(s, "unit", np.float64) for s in (tile.a, tile.b))
    step = max(1, PRODUCTS // ua.shape[1])
    for batch in asked:
        for lefts, rights in zip(batch.column("left"), batch.column("right"), strict=True):
            left, right = np.array(lefts.values), np.array(rights.values)
            for k in range(0, len(left), step):
                i, j = left[k : k + step], right[k : k + step]
                is_link = np.einsum("ij,ij->i", ua[i], ub[j]) >= near
                tile.add(i[is_link], j[is_link])
    yield from tile.sums()


def _sides(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Both blocks of each tile, as rows of side 0 and 1; a tile of one block has one."""
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("block")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("block")),
    )
    each = pairs.select("a", "b", F.explode(F.filter(ends, lambda e: (e["side"] == 0) | (F.col("a") != F.col("b")))).alias("e"))
    return each.select("a", "b", "e.side", "e.block").join(blocks, "block")


def links_of(found: DataFrame, near: float, least_block: int = LEAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, node, many, least) of distinct vectors and (node, links, root) of their tiles."""
    size = max(least_block, min(MOST_BLOCK, found.count() // 64))
    nodes = blocks_of(found, size)
    blocks = materialize(
        nodes.select("block", "node", "many", "vector").groupBy("block").applyInArrow(_block, BLOCKS_DDL), "blocks"
    )
    pairs = tiles(blocks, near)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compared(pa.Table.from_batches(batches), near)

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(settled(left, right.to_batches(max_chunksize=1), near), FOUND)

    narrow = blocks.select("block", "dim", "first", "many", "q", "scale", "error")
    first = materialize(_sides(pairs, narrow).groupBy("a", "b").applyInArrow(compare, FOUND_DDL), "tiles")
    unsure = first.where("`left` IS NOT NULL").select("a", "b", "left", "right")
    full = _sides(unsure.select("a", "b").distinct(), blocks.select("block", "dim", "first", "many", "unit"))
    asked = unsure.withColumnsRenamed({"a": "of_a", "b": "of_b"}).groupBy("of_a", "of_b")
    second = materialize(full.groupBy("a", "b").cogroup(asked).applyInArrow(settle, FOUND_DDL), "settled")
    sums = first.unionByName(second).where("node IS NOT NULL")
    each = sums.select(F.explode(F.arrays_zip("node", "links", "root")).alias("x")).select("x.*")
    return nodes.select("key", "node", "many", "least"), each


def dedup(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    near: float = SIMILARITY,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each vector.

    Two vectors are linked when their cosine in double precision is at least
    ``near``, which is positive.  Vectors of different sizes are not linked, nor
    are those without a direction, see :func:`usable`; their component is
    themselves.  Rows of one vec_id are vectors of their own, and each is a link
    of the other where they are alike.  A null vec_id is never a component's id,
    unless no row of it has one.
    """
    # Adding 0 makes a negative zero a positive one.
    zero = F.transform(quoted(embedding), lambda x: x.cast("double") + F.lit(0.0))
    slim = vectors.select(
        quoted(vec_id).alias("id"), F.when(usable(vectors, embedding), zero).alias("vector")
    ).withColumn("key", F.when(F.col("vector").isNotNull(), row_key("vector")))
    found = distinct_vectors(slim.where("vector IS NOT NULL"))
    nodes, each = links_of(found, near, least_block)
    degrees = each.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(each.select("node", "root"), "node", "root").select("node", F.col("root").alias("top"))
    known = nodes.join(degrees, "node", "left").join(roots, "node", "left")
    known = materialize(known.withColumn("top", F.coalesce("top", "node")), "known")
    tops = materialize(known.groupBy("top").agg(F.min("least").alias("component")), "components")
    classes = materialize(
        known.join(tops, "top").select(
            "key", "component", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links")
        ),
        "classes",
    )
    linked = slim.select("id", "key").join(classes, "key").select("id", "links", "component")
    alone = slim.where("key IS NULL").select(
        "id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
