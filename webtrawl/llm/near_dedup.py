"""Near duplicates by improved consistent weighted sampling.

A text is the multiset of its shingles of five words (all its words, if fewer),
each weighted by its count times a smoothed inverse document frequency.  ICWS
draws shingles so that two texts agree in a draw with the probability of their
weighted Jaccard similarity.  Bands of draws bring candidates together, whole
texts decide, and linked texts form classes.

Inside a bucket texts are first compared with one pivot, the text that shares
most buckets with others.  Then only texts that are still in different classes
meet, in blocks, and of these only the pairs come out that their profiles allow
to be similar.  So a group of copies never unfolds into its pairs, and no
candidate link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, orderable, quoted
from webtrawl.operators.components import components
from webtrawl.llm.words import WordHasher, mixed, slices_of, starts_of
from webtrawl.sources.scratch import broadcast_if_small, materialize

SHINGLE = 5
SIMILARITY = 0.8

# Draws by band; a pair of similarity 0.8 shares a band with probability 0.9992.
BANDS = 10
BAND_DRAWS = 3
DRAWS = BANDS * BAND_DRAWS

# A profile is a text's weight by hashed cells of its shingles, in units of 1 / 256.
# What two texts share cancels out in every cell, so the sum of differences of
# two profiles is a lower bound, never missed, of the weight in which they differ.
PROFILE = 256
UNITS = 256

# Texts of a bucket that meet in one task: so many on either side.
MEETING = 1_024

# Document frequencies are counted in so many cells, which go to every task: 2 MiB.
CELLS = 1 << 18

# The weight of a shingle lies between 1 (in every text) and 1 + IDF_SHARE times
# its count.  Copies of a text make its shingles common; a larger share would let
# what one copy adds outweigh what all of them hold in common.
IDF_SHARE = 0.25

BLOCK_CHARS = 400_000


@dataclass
class Features:
    """Distinct shingles of many texts end to end: text k's are ``starts[k]:starts[k + 1]``."""

    shingles: np.ndarray
    counts: np.ndarray
    starts: np.ndarray


class Shingler:
    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words = WordHasher()

    def __call__(self, texts: list[str]) -> Features:
        words, starts = self.words(texts)
        sizes = np.diff(starts)
        # A text of fewer words than a shingle has one shingle of them all.
        numbers = np.where(sizes == 0, 0, np.maximum(sizes - self.size + 1, 1))
        text = np.repeat(np.arange(len(texts)), numbers)
        at = np.arange(len(text)) - np.repeat(starts_of(numbers)[:-1], numbers) + starts[:-1][text]
        end = starts[1:][text]
        value = np.zeros(len(text), np.uint64)
        for k in range(self.size):
            there = at + k < end
            word = words[np.minimum(at + k, max(len(words) - 1, 0))]
            value = mixed(value * np.uint64(3) + np.where(there, word, np.uint64(k + 1)))
        # The text's number above 44 bits of the shingle, so that one sort does.
        keys = np.sort((text.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        distinct = keys[first]
        owner = (distinct >> np.uint64(44)).astype(np.int64)
        return Features(
            distinct & np.uint64((1 << 44) - 1),
            np.diff(np.append(first, len(keys))),
            np.searchsorted(owner, np.arange(len(texts) + 1)),
        )


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def count_documents(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """For each cell the number of texts with a shingle in it, over all texts; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for part in slices_of(batch, "text", BLOCK_CHARS):
                features = shingler(part.column("text").to_pylist())
                np.add.at(seen, cells_of(features.shingles), 1)
                seen[CELLS] += len(part)
        cells = np.flatnonzero(seen)
        yield pa.record_batch({"cell": pa.array(cells, pa.int32()), "n": pa.array(seen[cells])})

    parts = docs.select(empty_if_null(quoted(text)).alias("text")).mapInArrow(run, "cell int, n bigint")
    counts = np.zeros(CELLS + 1, np.int64)
    # At most CELLS + 1 rows, whatever the corpus.
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.cell] = r.n
    return counts[:CELLS], int(counts[CELLS])


def idf_of(counts: np.ndarray, texts: int) -> np.ndarray:
    return 1 + IDF_SHARE * np.log((texts + 1) / (np.minimum(counts, texts) + 1)) / np.log(texts + 2)


class Sampler:
    """Improved consistent weighted sampling, with tabled quantiles of its gamma variables.

    For a shingle of weight w and a draw with r, c ~ Gamma(2, 1) and b ~ U(0, 1),
    all hashed from both: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the
    shingle of the least a is drawn, together with its t.
    """

    def __init__(self, draws: int = DRAWS, seed: int = 41):
        self.seeds = mixed(np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed << 20))
        self.r = _gamma2(1 << 12).astype(np.float32)
        self.one_by_r = np.float32(1) / self.r
        self.log_c = np.log(_gamma2(1 << 16)).astype(np.float32)

    def __call__(self, features: Features, weights: np.ndarray) -> np.ndarray:
        """Draws by text, 32 bits each; 0 for a text without shingles."""
        sizes = np.diff(features.starts)
        full = np.flatnonzero(sizes)
        found = np.zeros((len(sizes), len(self.seeds)), np.int32)
        if not len(full):
            return found
        begin, sizes = features.starts[:-1][full], sizes[full]
        log_w = np.log(weights).astype(np.float32)
        owner = np.repeat(np.arange(len(full)), sizes)
        for d, seed in enumerate(self.seeds):
            z = (features.shingles ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            z ^= z >> np.uint64(29)
            which = (z >> np.uint64(52)).astype(np.intp)
            b = ((z >> np.uint64(28)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_w * self.one_by_r[which] + b)
            a = self.log_c[(z & np.uint64(0xFFFF)).astype(np.intp)] - self.r[which] * (t - b + 1)
            least = np.minimum.reduceat(a, begin)
            hits = np.flatnonzero(a == least[owner])
            # Of equal values the smallest shingle, which comes first, counts.
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            drawn = mixed(features.shingles[hits] ^ mixed(t[hits].astype(np.int64).view(np.uint64)))
            found[full, d] = (drawn >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return found


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``n`` equal steps, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def _fingerprints(features: Features) -> list[bytes]:
    """128 bits of each text's shingles with their counts; equal ones are copies."""
    value = mixed(features.shingles * np.uint64(5) + mixed(features.counts.astype(np.uint64)))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(v)]) for v in (value, mixed(value + np.uint64(1)))]
    parts = np.stack([s[features.starts[1:]] - s[features.starts[:-1]] for s in sums], axis=1)
    return [row.tobytes() for row in np.ascontiguousarray(parts)]


SKETCH = "key struct<a:bigint,b:bigint>, copy binary, weight double, profile binary, bands array<bigint>"


def sketch(docs: DataFrame, counts: np.ndarray, texts: int) -> DataFrame:
    """(id, key, copy, weight, profile, bands) of (id, text, key) rows."""
    sent = docs.sparkSession.sparkContext.broadcast(idf_of(counts, texts))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, idf = Shingler(), Sampler(), sent.value
        for batch in batches:
            for part in slices_of(batch, "text", BLOCK_CHARS):
                features = shingler(part.column("text").to_pylist())
                weights = features.counts * idf[cells_of(features.shingles)]
                draws = sampler(features, weights)
                bands = np.zeros((len(draws), BANDS), np.uint64)
                for k in range(DRAWS):
                    bands[:, k % BANDS] = mixed(bands[:, k % BANDS] * np.uint64(3) + draws[:, k].view(np.uint32))
                total = np.concatenate([[0], np.cumsum(weights)])[features.starts]
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "key": part.column("key"),
                        "copy": pa.array(_fingerprints(features), pa.binary()),
                        "weight": pa.array(np.diff(total)),
                        "profile": pa.array(_profiles(features, weights), pa.binary()),
                        "bands": _lists(bands.view(np.int64)),
                    }
                )

    return docs.select("id", "text", "key").mapInArrow(run, f"id {kind}, {SKETCH}")


def _lists(rows: np.ndarray) -> pa.Array:
    starts = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(starts, pa.array(rows.reshape(-1)))


def _profiles(features: Features, weights: np.ndarray) -> list[bytes]:
    texts = len(features.starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(features.starts))
    cell = ((features.shingles >> np.uint64(24)) & np.uint64(PROFILE - 1)).astype(np.int64)
    sums = np.bincount(owner * PROFILE + cell, weights, texts * PROFILE).reshape(texts, PROFILE)
    # Cut at the largest number; a difference only gets smaller by it.
    return [row.tobytes() for row in np.minimum(np.rint(sums * UNITS), 32767).astype("<i2")]


def _as_profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, PROFILE).astype(np.int32)


def _can_be_near(profiles: np.ndarray, weights: np.ndarray, own: np.ndarray, weight, near: float):
    """Whether texts can be as similar as ``near`` to one, or each to its own, by their profiles.

    The similarity is s exactly if the differing weight is (1 - s) / (1 + s) of
    the sum of both weights.
    """
    apart = np.abs(profiles - own).sum(axis=-1) / UNITS
    rounding = PROFILE / UNITS + 1e-6 * (weights + weight)
    return apart - rounding <= (1 - near) / (1 + near) * (weights + weight)


def _plausible(pairs: DataFrame, side: DataFrame, near: float) -> DataFrame:
    """The (x, y) pairs whose profiles allow a similarity of ``near``."""

    def of(name: str) -> DataFrame:
        return side.select(
            F.col("key").alias(name), F.col("weight").alias(f"w{name}"), F.col("profile").alias(f"p{name}")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = (_as_profiles(batch.column(c)) for c in ("px", "py"))
            wx, wy = (batch.column(c).to_numpy() for c in ("wx", "wy"))
            keep = pa.array(_can_be_near(px, wx, py, wy, near))
            yield batch.select(["x", "y"]).filter(keep)

    both = pairs.distinct().join(of("x"), "x").join(of("y"), "y").select("x", "y", "px", "py", "wx", "wy")
    return both.mapInArrow(run, f"x {KEY}, y {KEY}")


KEY = "struct<a:bigint,b:bigint>"


def _meetings(inside: DataFrame, side: DataFrame, near: float) -> DataFrame:
    """(x, y): texts of different classes that share a bucket and can be as similar as ``near``.

    ``inside`` has the members of buckets with several classes: each one outside
    its bucket's largest class meets all others.  A bucket is cut into blocks,
    and every two of them meet in a group of their own, so no task holds more
    than two blocks.  A pair comes out of the first band that it shares.
    """
    blocks_ = F.ceil(F.col("n") / MEETING).cast("int")
    cut = (
        inside.join(side, "key")
        .withColumn("blocks", blocks_)
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("asks", F.col("root") != F.col("largest"))
        .withColumn("is_largest", ~F.col("asks"))
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    columns = ["band", "bucket", "key", "root", "is_largest", "weight", "profile", "bands"]
    asking = cut.where("asks").select(*columns, F.lit(True).alias("asking"), F.col("own").alias("i"), each)
    asked = cut.select(*columns, F.lit(False).alias("asking"), F.col("own").alias("j"), each)
    met = asking.withColumnRenamed("other", "j").unionByName(asked.withColumnRenamed("other", "i"))
    group = ["band", "bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            marks = np.stack([rows.column(c).to_numpy() for c in group])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            # The last group may go on in the next batch.
            for start, end in zip(np.append(0, edges[:-1]), edges, strict=False):
                yield from _met(rows.slice(start, end - start), near)
            last = int(edges[-1]) if len(edges) else 0
            rest = rows.slice(last).combine_chunks().to_batches()[0] if last < len(rows) else None
        if rest is not None:
            yield from _met(pa.Table.from_batches([rest]), near)

    ordered = met.repartition(*group).sortWithinPartitions(*group).select(*group, "asking", *columns[2:])
    return ordered.mapInArrow(run, f"x {KEY}, y {KEY}")


def _met(rows: pa.Table, near: float) -> Iterator[pa.RecordBatch]:
    """The pairs of one group, each asking text with each asked one."""
    asking = rows.column("asking").to_numpy()
    if not asking.any() or asking.all():
        return
    rows = rows.combine_chunks()
    key, root = (
        np.stack([rows.column(c).chunk(0).field(k).to_numpy() for k in (0, 1)], axis=1) for c in ("key", "root")
    )
    profiles, weights = _as_profiles(rows.column("profile")), rows.column("weight").to_numpy()
    bands = rows.column("bands").chunk(0).flatten().to_numpy().reshape(-1, BANDS)
    largest, band = rows.column("is_largest").to_numpy(), rows.column("band")[0].as_py()
    asked = np.flatnonzero(~asking)
    found: list[tuple[int, int]] = []
    for q in np.flatnonzero(asking):
        other = (root[asked] != root[q]).any(axis=1)
        # Two texts outside the largest class ask each other: one of them does.
        earlier = (key[asked, 0] > key[q, 0]) | ((key[asked, 0] == key[q, 0]) & (key[asked, 1] > key[q, 1]))
        m = asked[other & (largest[asked] | earlier)]
        m = m[(bands[m] == bands[q]).argmax(axis=1) == band]
        m = m[_can_be_near(profiles[m], weights[m], profiles[q], weights[q], near)]
        found += [(q, k) for k in m]
    if found:
        keys = rows.column("key").chunk(0)
        x, y = (keys.take(pa.array([pair[k] for pair in found])) for k in (0, 1))
        yield pa.record_batch({"x": x, "y": y})


def _verified(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, near: float) -> DataFrame:
    """The (x, y) pairs of text keys whose weighted Jaccard similarity is ``near`` or more."""
    spark = pairs.sparkSession
    wanted = materialize(
        pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct(), "wanted"
    )
    # Copies in the same words and letters give one text.
    texts = materialize(
        docs.select("key", "text")
        .join(broadcast_if_small(wanted, "key"), "key", "left_semi")
        .groupBy("key")
        .agg(F.min("text").alias("text")),
        "texts",
    )
    both = (
        pairs.join(texts.select(F.col("key").alias("y"), F.col("text").alias("second")), "y")
        .join(texts.select(F.col("key").alias("x"), F.col("text").alias("first")), "x")
        .select("x", "y", "first", "second")
    )
    sent = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, weigh = Shingler(), sent.value
        for batch in batches:
            similar = []
            for part in slices_of(batch, "first", BLOCK_CHARS):
                first, second = (part.column(c).to_pylist() for c in ("first", "second"))
                features = shingler([t for pair in zip(first, second, strict=True) for t in pair])
                similar += _similarities(features, weigh)
            keep = pa.array([s >= near - 1e-9 for s in similar], pa.bool_())
            yield pa.record_batch(
                {"x": batch.column("x"), "y": batch.column("y"), "similarity": pa.array(similar, pa.float64())}
            ).filter(keep)

    return both.mapInArrow(run, f"x {KEY}, y {KEY}, similarity double")


def _similarities(features: Features, idf: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity of texts 0 and 1, 2 and 3, …"""
    found = []
    for k in range(0, len(features.starts) - 1, 2):
        a, m, b = features.starts[k : k + 3]
        left, right = features.shingles[a:m], features.shingles[m:b]
        _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        weight = idf[cells_of(features.shingles[a:b])]
        n, w = features.counts[a:b], weight * features.counts[a:b]
        shared = (np.minimum(n[: m - a][i], n[m - a :][j]) * weight[: m - a][i]).sum()
        whole = w.sum() - shared
        found.append(float(shared / whole) if whole else 1.0)
    return found


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: float = SIMILARITY
) -> DataFrame:
    """(id, key, class_id, class_size, links, root), a row for each document.

    ``class_id`` is the smallest doc_id of all texts linked, directly or through
    others, at a similarity of ``near`` or more; ``links`` counts the links
    of the text's shingles to others that were verified to build the class, not all
    texts like it: two of one class are not compared again.  Texts with the same shingles
    are copies.  Null texts and texts without a word have no shingles and are
    copies of each other.  A class without any doc_id has a null ``class_id``.
    ``key`` stands for the whole text, ``root`` for the class.
    """
    slim = docs.select(
        quoted(doc_id).alias("id"), empty_if_null(quoted(text)).alias("text")
    ).withColumn("key", text_key("text"))
    counts, number = count_documents(slim)
    idf = idf_of(counts, number)
    sketches = materialize(sketch(slim, counts, number), "sketches")

    # One node for each set of copies; its text is any one of theirs.
    nodes = materialize(
        sketches.groupBy("copy").agg(
            F.min("id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.min("key").alias("key"),
            F.first("weight").alias("weight"),
            F.first("profile").alias("profile"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    members = nodes.where("weight > 0").select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("n > 1"), "buckets")
    full = materialize(members.join(shared, ["band", "bucket"]), "members")
    side = nodes.select("key", "weight", "profile", "bands")

    # The pivot of a bucket is the member with most company in all its buckets:
    # the text that a group's copies were made from has more than any copy.
    company = materialize(full.groupBy("key").agg(F.sum("n").alias("company")), "company")
    pivots = materialize(
        full.join(company, "key").groupBy("band", "bucket").agg(F.max(F.struct("company", "key"))["key"].alias("pivot")),
        "pivots",
    )
    stars = full.join(pivots, ["band", "bucket"]).where("key != pivot")
    first = materialize(
        _plausible(stars.select(F.col("pivot").alias("x"), F.col("key").alias("y")), side, near), "pairs"
    )
    links = materialize(_verified(first, slim, idf, near), "links")
    root = components(links.select("x", "y"), "x", "y")

    # Buckets that still hold several classes.
    placed = full.join(root, full["key"] == root["node"], "left").select(
        "band", "bucket", "n", "key", F.coalesce("root", "key").alias("root")
    )
    parts = placed.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    several = materialize(
        parts.groupBy("band", "bucket")
        .agg(F.max(F.struct("m", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1"),
        "several",
    )
    inside = materialize(placed.join(several, ["band", "bucket"]), "open")
    tried = first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    met = _meetings(inside, side, near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = materialize(met.join(tried, ["x", "y"], "left_anti"), "cross")
    links = materialize(links.unionByName(_verified(second, slim, idf, near)), "all-links")
    root = components(links.select("x", "y"), "x", "y")

    degree = (
        links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    )
    of_node = (
        nodes.select("copy", "key", "id", "copies")
        .join(root.withColumnRenamed("node", "key"), "key", "left")
        .join(degree.withColumnRenamed("node", "key"), "key", "left")
        .select(
            "copy", "id", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
        )
    )
    of_class = of_node.groupBy("root").agg(
        F.min("id").alias("class_id"), F.sum("copies").alias("class_size")
    )
    known = of_node.select("copy", "root", "links").join(of_class, "root")
    rows = sketches.select("id", "key", "copy").join(known, "copy")
    return rows.select("id", "key", "class_id", "class_size", "links", "root")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one whole row of each class, one with the smallest doc_id (a null id last).

    Rows equal in doc_id and text are told apart by their other columns, the
    greatest staying.
    """
    mark = F.struct("id", "key").alias("mark")
    marks = (
        classes(docs, doc_id, text, near)
        .groupBy("root", mark)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("order", F.struct(F.col("mark.id").isNull().alias("unnamed"), "mark"))
    )
    marks = materialize(marks, "marks")
    chosen = materialize(marks.groupBy("root").agg(F.min("order")["mark"].alias("best")), "chosen")
    # Few rows go or are repeated; while they fit a broadcast, no text moves.
    judged = marks.join(chosen, "root").withColumn("stays", F.col("mark") == F.col("best"))
    judged = materialize(
        judged.where(~F.col("stays") | (F.col("rows") > 1)).select("mark", "stays"), "judged"
    )
    own = F.struct(quoted(doc_id).alias("id"), text_key(empty_if_null(quoted(text))).alias("key"))
    rows = docs.select(own.alias("mark"), F.struct("*").alias("row"))
    alone = rows.join(broadcast_if_small(judged.select("mark"), "mark"), "mark", "left_anti")
    total = F.struct(*[F.col("row")[c] for c in orderable(docs)])
    repeated = (
        rows.join(broadcast_if_small(judged.where("stays").select("mark"), "mark"), "mark", "left_semi")
        .groupBy("mark")
        .agg(F.max_by("row", total).alias("row"))
    )
    return alone.select("row.*").unionByName(repeated.select("row.*"))
