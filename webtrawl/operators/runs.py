"""Runs of tokens that may equal one of many phrases.

The hashes of the phrases are set in a Bloom filter of bounded size, which every
task holds, however many phrases there are.  Token lists are looked through where
they lie: of each place, the hashes of its runs follow from one another, and only
runs whose bits are all set become text and move.  A few of these equal no phrase,
so an exact join has to follow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the filter for each phrase, and those of them that are set.
BITS_PER_PHRASE = 64
PROBES = 4

# The filter comes in blocks, as the bitmap functions have them.  So many bound it at
# 128 MiB; beyond 17 million phrases it fills up and lets more runs through.
BLOCK_BITS = 32_768
MAX_BLOCKS = 32_768

# Places of a token list in one row, and tokens looked through at once.
PIECE = 1_024
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [
    np.uint64(f)
    for f in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
]


def block_count(phrases: int) -> int:
    """Blocks of the filter: a power of two with BITS_PER_PHRASE for each phrase, within the bound."""
    wanted = max(1, phrases * BITS_PER_PHRASE // BLOCK_BITS)
    return min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda token: F.xxhash64(token))


def _run_hashes(tokens: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the runs of n tokens, by their first place), by growing n."""
    run = tokens
    for n in range(1, min(longest, len(tokens)) + 1):
        if n > 1:
            run = run[:-1] * _BASE + tokens[n - 1 :]
        yield n, run


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((hashes * _FACTORS[probe]) >> np.uint64(64 - bits)).view(np.int64)


def _lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch of lists without nulls, and where each list begins and the last ends."""
    values = batch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = batch.offsets.to_numpy().astype(np.int64)
    return values, offsets - offsets[0]


def build_filter(phrases: DataFrame, longest: int) -> np.ndarray:
    """The filter of ``phrases`` (block), texts of up to ``longest`` tokens, as bytes."""
    blocks = block_count(phrases.count())
    bits = (blocks * BLOCK_BITS).bit_length() - 1

    def marks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values, offsets = _lists(batch)
            lengths, whole = np.diff(offsets), np.zeros(len(batch), np.uint64)
            for n, run in _run_hashes(values, longest):
                whole[lengths == n] = run[offsets[:-1][lengths == n]]
            marks = np.stack([_places(whole, p, bits) for p in range(PROBES)], axis=1)
            ends = np.arange(0, marks.size + 1, PROBES, dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, marks.ravel())

    marks = F.arrow_udf(marks_of, "array<bigint>")(token_hashes(F.split("block", " ")))
    placed = phrases.select(F.explode_outer(marks).alias("mark")).select(
        F.floor(F.col("mark") / BLOCK_BITS).cast("int").alias("block"), (F.col("mark") % BLOCK_BITS).alias("bit")
    )
    bitmap = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    # At most MAX_BLOCKS rows of 4 KiB.
    for row in placed.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        start = row.block * BLOCK_BITS // 8
        bitmap[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def _flagged(values: np.ndarray, offsets: np.ndarray, bitmap: np.ndarray, lengths: Sequence[int]):
    """(place among the values, length) of the runs within a list whose bits are all set."""
    bits = (len(bitmap) * 8).bit_length() - 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    last = np.repeat(offsets[:-1] + PIECE, np.diff(offsets))
    at, long = [], []
    for n, run in _run_hashes(values, max(lengths)):
        if n not in lengths:
            continue
        found = None
        for probe in range(PROBES):
            place = _places(run if found is None else run[found], probe, bits)
            is_set = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            found = np.flatnonzero(is_set) if found is None else found[is_set == 1]
        found = found[(found + n <= ends[found]) & (found < last[found])]
        at.append(found)
        long.append(np.full(len(found), n))
    return (np.concatenate(at), np.concatenate(long)) if at else (np.zeros(0, int), np.zeros(0, int))


def possible_runs(tokenised: DataFrame, phrases: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(url, n_tokens, pos, block): runs of documents that may equal one of ``phrases`` (block).

    ``lengths`` are the numbers of tokens that the phrases have.  Every run that
    equals a phrase is among the rows, and very few others.
    """
    longest = max(lengths)
    sent = tokenised.sparkSession.sparkContext.broadcast(build_filter(phrases, longest))
    shift = longest.bit_length()

    def runs_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values, offsets = _lists(batch)
            counts, runs, row = np.zeros(len(batch) + 1, np.int32), [], 0
            while row < len(batch):
                # Whole lists, as many as a chunk holds.
                until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
                own = offsets[row : until + 1] - offsets[row]
                place, n = _flagged(values[offsets[row] : offsets[until]], own, sent.value, lengths)
                of = np.searchsorted(own, place, "right") - 1
                order = np.argsort(of, kind="stable")
                runs.append(((place - own[of]) << shift | n)[order])
                counts[row + 1 : until + 1] = np.bincount(of, minlength=until - row)
                row = until
            yield pa.ListArray.from_arrays(
                np.cumsum(counts, dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *runs])
            )

    find = F.arrow_udf(runs_of, "array<bigint>")
    # A row holds a bounded piece of a document, and what its last runs need of the next one.
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(PIECE)),
        lambda at: F.struct(
            at.alias("from"), F.slice("tokens", at + 1, F.lit(PIECE + longest - 1)).alias("tokens")
        ),
    )
    place, length = F.shiftright("_run", shift).cast("int"), F.col("_run").bitwiseAND(F.lit((1 << shift) - 1))
    # Single tokens are fetched by place: ``slice`` would copy the whole list.
    text = F.concat_ws(
        " ", *[F.when(length > j, F.get(F.col("_piece.tokens"), place + j)) for j in range(longest)]
    )
    return (
        tokenised.where(F.col("n_tokens") > 0)
        .select("url", "n_tokens", F.explode_outer(pieces).alias("_piece"))
        .withColumn("_runs", find(token_hashes(F.col("_piece.tokens"))))
        # The inner form would test for empty lists first, and so look through them twice.
        .select("url", "n_tokens", "_piece", F.explode_outer("_runs").alias("_run"))
        .where(F.col("_run").isNotNull())
        .select("url", "n_tokens", (F.col("_piece.from") + place).alias("pos"), text.alias("block"))
    )
