"""SpotSigs: fingerprints of chains of content words after common words.

An anchor is a common word; its signature is the anchor and the next two content
words.  One content word in eight, by its hash, is an anchor too, and the first
one, two and three words of a text are signatures, so that short texts and those
without common words have some.  The fingerprint is the multiset of a text's
signatures, 32 bits each, a repeated one being numbered.  Likeness is the Jaccard
similarity of two multisets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, quoted, row_key
from webtrawl.llm.words import WordHasher, blocks, mixed
from webtrawl.sources.scratch import materialize

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it not of on or "
    "that the their they this to was were which with you "
    "au aux avec ce dans de des du en est et il la le les mais ne ou par pas pour que qui sa se son sur un une "
    "als am auch auf aus bei das dem den der des die ein eine er im in ist mit nicht sich sie sind so und von war zu "
    "al como con del el ella en era es esta fue ha las lo los más no o para pero por se sin su también una y"
).split()

CHAIN = 2

# One content word in so many is an anchor.
CONTENT_ANCHORS = 8

BLOCK_CHARS = 400_000


class Signer:
    """Multisets of signatures of texts, as sets: sorted, distinct 32-bit numbers."""

    def __init__(self, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN):
        self.words, self.chain = WordHasher(), chain
        self.common = np.sort(self.words(sorted(set(anchors)))[0])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of all texts end to end, and where each text's begins (one place more).

        Near the end of a text a chain has fewer words; an anchor that no content
        word follows has none.  A text without any word but with other characters
        has one signature for them all; a blank text has none.
        """
        words, starts = self.words(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        place = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        content = self.common[place] != words
        picked = content & (words % np.uint64(CONTENT_ANCHORS) == 0)
        anchors = np.flatnonzero(~content | picked)
        inner = np.flatnonzero(content)
        # The place of the first content word after each anchor.
        after = np.searchsorted(inner, anchors, "right")
        value = words[anchors]
        for k in range(self.chain):
            at = after + k
            word = inner[np.minimum(at, max(len(inner) - 1, 0))] if len(inner) else np.zeros_like(at)
            same = (at < len(inner)) & (text[word] == text[anchors]) if len(inner) else at < 0
            if k == 0:
                followed = same
            value = mixed(value * np.uint64(3) + np.where(same, words[word] if len(words) else 0, np.uint64(k + 1)))
        value, owner = value[followed], text[anchors][followed]

        # The first one, two, … words of each text.
        filled = np.flatnonzero(np.diff(starts))
        begin, end = starts[:-1][filled], starts[1:][filled]
        first, firsts, openers = np.full(len(filled), 11, np.uint64), [], []
        for k in range(self.chain + 1):
            there = begin + k < end
            word = words[np.minimum(begin + k, end - 1)] if len(words) else first
            first = mixed(first * np.uint64(3) + word)
            firsts.append(first[there])
            openers.append(filled[there])

        # Texts of other characters only.
        other = [k for k in np.flatnonzero(np.diff(starts) == 0) if not texts[k].isspace() and texts[k]]
        marks = [int.from_bytes(hashlib.md5(texts[k].strip().encode("utf-8", "surrogatepass")).digest()[:8]) for k in other]

        owners = np.concatenate([owner, *openers, np.array(other, np.int64)]).astype(np.uint64)
        values = np.concatenate([value, *firsts, np.array(marks, np.uint64)])
        # The second, third, … occurrence of a signature is an element of its own.
        keys = np.sort((owners << np.uint64(32)) | (values >> np.uint64(32)))
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        times = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
        low, high = keys & np.uint64(0xFFFFFFFF), keys & ~np.uint64(0xFFFFFFFF)
        again = mixed((low << np.uint64(20)) + times.astype(np.uint64)) >> np.uint64(32)
        keys = np.unique(np.where(times > 0, high | again, keys))
        sets = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return sets, np.searchsorted((keys >> np.uint64(32)).astype(np.int64), np.arange(len(texts) + 1))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Similarity of two sorted sets, 1 for two empty ones; 0 where their sizes rule out ``least``.

    A similarity cannot exceed the quotient of the sizes, so pairs that cannot
    reach ``least`` are not compared.
    """
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (small + large - shared)


def as_text(signatures: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return signatures.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


# --- Fingerprints against a set of queries ---------------------------------------

SIMILARITY = 0.8


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text is empty."""
    slim = docs.select(quoted(doc_id).alias("doc_id"), empty_if_null(quoted(text)).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in blocks(texts, BLOCK_CHARS):
                sets, starts = signer(texts[start:end])
                found = [as_text(sets[starts[k] : starts[k + 1]]) for k in range(end - start)]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(start, end - start),
                        "fingerprint": pa.array(found, pa.string()),
                    }
                )

    return slim.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _sets(found: DataFrame) -> DataFrame:
    """(key, fingerprint, signatures, n): each fingerprint once, with its signatures."""
    number = (F.length("fingerprint") / 8).cast("int")
    signature = lambda k: F.substring("fingerprint", k * 8 + 1, F.lit(8))
    signatures = F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), signature))
    return (
        found.select("fingerprint").distinct()
        .withColumn("n", number)
        .where("n > 0")
        .withColumns({"signatures": signatures, "key": row_key("fingerprint")})
    )


def _prefixes(sets: DataFrame, counts: DataFrame, near: float) -> DataFrame:
    """(key, n, signature) for the rarest signatures of each set.

    Two sets as similar as ``near`` share one of their n - ceil(near n) + 1 first
    signatures, in any order that is the same for all; rare ones come first.
    """
    each = sets.select("key", "n", F.explode("signatures").alias("signature"))
    ranked = (
        each.join(counts, "signature", "left")
        .groupBy("key", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)), "signature"))).alias("order"))
    )
    first = F.col("n") - F.ceil(F.col("n") * near - 1e-9).cast("int") + 1
    return ranked.select("key", "n", F.explode(F.slice("order", F.lit(1), first)).alias("s")).select(
        "key", "n", F.col("s.signature").alias("signature")
    )


def search(queries: DataFrame, found: DataFrame, near: float = SIMILARITY) -> DataFrame:
    """(query, fingerprint, likeness): the fingerprints at least as like each query as ``near``.

    Both need a ``fingerprint`` column.  Equal fingerprints count once: join the
    documents of either side to them.  Sets are partitioned by length, so that a
    set meets only its own and the two neighbouring partitions, and in these only
    sets that share a rare signature.  Pairs whose lengths rule out ``near`` are
    not compared.  Empty fingerprints are like each other and like no others.
    """
    asked, known = materialize(_sets(queries), "asked"), materialize(_sets(found), "known")
    counts = known.select(F.explode("signatures").alias("signature")).groupBy("signature").count()
    counts = materialize(counts, "counts")
    part = F.floor(F.log("n") / math.log(1 / near)).cast("int")
    left = _prefixes(asked, counts, near).select(
        F.col("key").alias("query_key"),
        F.col("n").alias("m"),
        "signature",
        F.explode(F.array(part - 1, part, part + 1)).alias("part"),
    )
    right = _prefixes(known, counts, near).withColumn("part", part)
    fits = F.least("m", "n") >= F.greatest("m", "n") * near - 1e-9
    pairs = left.join(right, ["signature", "part"]).where(fits).select("query_key", "key").distinct()
    own = asked.select(
        F.col("key").alias("query_key"), F.col("fingerprint").alias("query"), F.col("signatures").alias("own")
    )
    shared = F.size(F.array_intersect("signatures", "own"))
    likeness = shared / (F.col("n") + F.size("own") - shared)
    return (
        pairs.join(known, "key")
        .join(own, "query_key")
        .select("query", "fingerprint", likeness.alias("likeness"))
        .where(F.col("likeness") >= near - 1e-9)
        .unionByName(_empty_pair(queries, found))
    )


def _empty_pair(queries: DataFrame, found: DataFrame) -> DataFrame:
    """The pair of the empty fingerprint with itself, where both sides have it."""
    both = queries.select("fingerprint").intersect(found.select("fingerprint")).where("fingerprint = ''")
    return both.select(F.col("fingerprint").alias("query"), "fingerprint", F.lit(1.0).alias("likeness"))


# --- Each row with the next one -------------------------------------------------

# Bytes of text of a range, and the most ranges there are.  A range goes through
# a task as a stream, so a larger one needs no more memory.  The driver holds one
# key for each range, and SAMPLED keys for each to find their bounds.
RANGE_BYTES = 8 << 20
MOST_RANGES = 10_000
SAMPLED = 40


def _order_key(doc_id: Column, text: Column) -> Column:
    """The place of a row in descending doc_id, null last; texts in the order of their hashes."""
    return F.struct(
        doc_id.isNull().cast("long").alias("unnamed"),
        (-F.coalesce(doc_id, F.lit(0))).alias("id"),
        F.xxhash64(text).alias("hash"),
    )


def _as_keys(column: pa.StructArray) -> np.ndarray:
    parts = [column.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
    keys = np.empty(len(parts[0]), "i8, i8, i8")
    for name, part in zip(keys.dtype.names, parts, strict=True):
        keys[name] = part
    return keys


def _in_ranges(docs: DataFrame) -> DataFrame:
    """(part, halo, key, id, text): ranges of rows in order, each with the row that follows as halo.

    The range after the last is the first.  Bounds come from a sample of keys, as
    in any sort; where they lie changes no result.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(1, min(MOST_RANGES, math.ceil((size["bytes"] or 0) / RANGE_BYTES)))
    keyed = docs.withColumn("key", _order_key(F.col("id"), F.col("text")))
    share = min(1.0, SAMPLED * ranges / max(1, size["n"]))
    sample = sorted(tuple(r.key) for r in keyed.select("key").sample(share, seed=7).collect())
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    edges = np.array(sorted(set(bounds)), "i8, i8, i8")

    def range_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.searchsorted(edges, _as_keys(batch), "right"), pa.int32())

    part = F.arrow_udf(range_of, "int")
    firsts = keyed.select("key", part("key").alias("part")).groupBy("part").agg(F.min("key").alias("key"))
    begins = sorted((r.part, tuple(r.key)) for r in firsts.collect())
    before = {key: begins[k - 1][0] for k, (_, key) in enumerate(begins)}
    heads = np.array([key for _, key in begins], "i8, i8, i8")
    parts = np.array([p for p, _ in begins], np.int64)

    def ranges_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys = _as_keys(batch)
            at = np.searchsorted(heads, keys, "right") - 1
            is_head = heads[at] == keys
            found = [
                [p, before[tuple(key)]] if head else [p]
                for p, head, key in zip(parts[at].tolist(), is_head.tolist(), keys.tolist(), strict=True)
            ]
            yield pa.array(found, pa.list_(pa.int32()))

    placed = F.arrow_udf(ranges_of, "array<int>")
    return (
        keyed.select("id", "text", "key", F.posexplode(placed("key")).alias("halo", "part"))
        .repartition("part")
        .sortWithinPartitions("part", "halo", "key")
    )


FINGERPRINTED = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each whole text and of its edited text, and their likenesses.

    The next row is that of the next smaller doc_id, a null id coming last, and
    after the last row the first; rows of one doc_id follow in the order of a
    hash of their texts.  A single row is its own next.  A null text is empty:
    its fingerprint is empty, and two empty fingerprints are alike.  doc_id is an
    integer.
    """
    slim = docs.select(quoted(doc_id).cast("bigint").alias("id"), empty_if_null(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        rest: list[tuple] = []
        for batch in batches:
            rows = rest + list(zip(*(batch.column(c).to_pylist() for c in ("id", "text", "halo")), strict=True))
            # The last row waits for the one that follows it; the last of all is a halo.
            rest = rows[-1:]
            for start, end in blocks([r[1] for r in rows[:-1]], BLOCK_CHARS):
                yield _compared(signer, rows[start : end + 1])

    return _in_ranges(slim).select("id", "text", "halo").mapInArrow(run, f"doc_id bigint, {FINGERPRINTED}")


def _compared(signer: Signer, rows: list[tuple]) -> pa.RecordBatch:
    """Fingerprints of all rows but the last, each with the row after it, halos left out."""
    sets, starts = signer([r[1] for r in rows])
    own = [k for k in range(len(rows) - 1) if not rows[k][2]]
    changed = [edited(rows[k][1], rows[k + 1][1]) for k in own]
    edited_sets, edited_starts = signer(changed)

    def plain(k: int) -> np.ndarray:
        return sets[starts[k] : starts[k + 1]]

    other = [edited_sets[edited_starts[k] : edited_starts[k + 1]] for k in range(len(own))]
    return pa.record_batch(
        {
            "doc_id": pa.array([rows[k][0] for k in own], pa.int64()),
            "n_chars": pa.array([len(rows[k][1]) for k in own], pa.int64()),
            "edited_sha256": pa.array(
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()
            ),
            "fingerprint": pa.array([as_text(plain(k)) for k in own], pa.string()),
            "edited_fingerprint": pa.array([as_text(s) for s in other], pa.string()),
            "near_edited": pa.array([jaccard(plain(k), s) for k, s in zip(own, other, strict=True)], pa.float64()),
            "near_next": pa.array([jaccard(plain(k), plain(k + 1)) for k in own], pa.float64()),
        }
    )
