"""Token sequences of one length, packed best-fit-decreasing.

Documents are encoded, cut without loss into pieces of at most one sequence, and
packed: the longest piece first, each into the sequence with the least room that
still takes it, which a segment tree over the remaining capacities finds.

A task packs the documents of one block together and needs no others, so nothing
is shuffled; a block of a million tokens leaves next to no room unused.  Blocks go
over the batches that a task gets, so that only its last one may be small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from webtrawl.llm.common import quoted
from webtrawl.llm.sentencepiece_codec import BLOCK_CHARS, MODEL, Encoder, in_two
from webtrawl.llm.words import slices_of, starts_of

SEQUENCE = 2_048

# Sequences of one matrix, which is one row of the result.
MATRIX_ROWS = 64

# Id and position of the places after a sequence's last piece.
PAD = 0


class Capacities:
    """Open sequences by remaining capacity, with the least one that suffices.

    A segment tree over the capacities 0 … largest; each inner node knows whether
    some sequence below it is open.
    """

    def __init__(self, largest: int):
        self.leaves = 1 << largest.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        node = self.leaves + capacity
        while node and not self.open[node]:
            self.open[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least capacity of ``size`` or more, which is taken out."""
        node = self.leaves + size
        if not self.open[node]:
            # Up until there is an open subtree to the right, then down its left side.
            while node & 1 or not self.open[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.open[2 * node])
        capacity = node - self.leaves
        sequence = self.at[capacity].pop()
        if not self.at[capacity]:
            self.open[node] = 0
            node >>= 1
            while node and not (self.open[2 * node] or self.open[2 * node + 1]):
                self.open[node] = 0
                node >>= 1
        return capacity, sequence


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The pieces of each sequence, by their places in ``sizes``; equal sizes keep their order."""
    capacities, packed = Capacities(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = capacities.take(sizes[piece])
        if found is None:
            found = capacity, len(packed)
            packed.append([])
        room, sequence = found
        packed[sequence].append(piece)
        if room > sizes[piece]:
            capacities.add(room - sizes[piece], sequence)
    return packed


@dataclass
class Piece:
    doc: int  # place of the document in its block
    start: int  # its first token in the document
    size: int


def pieces_of(sizes: np.ndarray, sequence: int) -> list[Piece]:
    """Every document cut into pieces of ``sequence`` tokens and a rest."""
    return [
        Piece(doc, start, min(sequence, int(size) - start))
        for doc, size in enumerate(sizes)
        for start in range(0, int(size), sequence)
    ]


PACKED = (
    "n_rows int, ids binary, positions binary, cu_seqlens array<array<int>>, "
    "doc_ids array<array<{kind}>>, doc_starts array<array<int>>"
)


class _Block:
    """Encoded texts that are packed together."""

    def __init__(self):
        self.chars = 0
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.names: list = []

    def add(self, ids: np.ndarray, starts: np.ndarray, names: list) -> None:
        self.ids.append(ids.astype("<u2"))
        self.sizes.append(np.diff(starts))
        self.names += names

    def packed(self, sequence: int, matrix_rows: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        starts = starts_of(sizes)
        pieces = pieces_of(sizes, sequence)
        rows = best_fit_decreasing([p.size for p in pieces], sequence)
        for first in range(0, len(rows), matrix_rows):
            yield _matrix(rows[first : first + matrix_rows], pieces, ids, starts, self.names, kind, sequence)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    matrix_rows: int = MATRIX_ROWS,
    model: str | None = None,
) -> DataFrame:
    """Matrices of packed token ids, one in a row.

    ``ids`` and ``positions`` are matrices of ``n_rows`` by ``sequence`` little-endian
    16-bit numbers, row by row; positions begin again at 0 with each piece.
    ``cu_seqlens`` holds for each sequence where its pieces begin and where the
    last one ends; ``doc_ids`` and ``doc_starts`` say which document each piece is
    from and at which of its tokens it begins.  What follows the last piece is
    PAD.  Null and empty texts have no tokens and so no piece; repeated rows are
    packed as often as they occur.
    """
    if not 0 < sequence < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 tokens")
    path = model or public_tokenizers.path(MODEL)
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        if encoder.library.vocab_size() > 1 << 16:
            raise ValueError("ids of this model need more than 16 bits")
        block = _Block()
        for batch in chain.from_iterable(slices_of(b, "text", BLOCK_CHARS) for b in batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, kind_of = batch.column("doc_id").to_pylist(), batch.column("doc_id").type
            chars = sum(map(len, texts))
            if block.chars + chars > BLOCK_CHARS:
                yield from block.packed(sequence, matrix_rows, kind_of)
                block = _Block()
            block.chars += chars
            for places, part in in_two(texts):
                block.add(*encoder.encode(part), [names[k] for k in places])
        if block.names:
            yield from block.packed(sequence, matrix_rows, kind_of)

    return slim.mapInArrow(run, PACKED.format(kind=kind))


def _matrix(rows, pieces, ids, starts, names, kind, sequence) -> pa.RecordBatch:
    matrix = np.full((len(rows), sequence), PAD, "<u2")
    positions = np.full((len(rows), sequence), PAD, "<u2")
    ends, owners, begins = [], [], []
    for k, row in enumerate(rows):
        at = [0]
        for p in (pieces[piece] for piece in row):
            first = starts[p.doc] + p.start
            matrix[k, at[-1] : at[-1] + p.size] = ids[first : first + p.size]
            positions[k, at[-1] : at[-1] + p.size] = np.arange(p.size)
            at.append(at[-1] + p.size)
        ends.append(at)
        owners.append([names[pieces[piece].doc] for piece in row])
        begins.append([pieces[piece].start for piece in row])
    return pa.record_batch(
        {
            "n_rows": pa.array([len(rows)], pa.int32()),
            "ids": pa.array([matrix.tobytes()], pa.binary()),
            "positions": pa.array([positions.tobytes()], pa.binary()),
            "cu_seqlens": pa.array([ends], pa.list_(pa.list_(pa.int32()))),
            "doc_ids": pa.array([owners], pa.list_(pa.list_(kind))),
            "doc_starts": pa.array([begins], pa.list_(pa.list_(pa.int32()))),
        }
    )
