"""Packing: best fit as defined, nothing lost, positions reset."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece

from webtrawl.llm import packing


def by_definition(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_best_fit_decreasing():
    draw = random.Random(3)
    for _ in range(300):
        capacity = draw.randrange(1, 70)
        sizes = [draw.randrange(1, capacity + 1) for _ in range(draw.randrange(0, 80))]
        packed = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(p for row in packed for p in row) == list(range(len(sizes)))
        assert sorted(capacity - sum(sizes[p] for p in row) for row in packed) == by_definition(sizes, capacity)


def unpack(matrices, sequence):
    """Tokens of each document, by doc_id, out of the pieces; copies of an id are told apart by order."""
    pieces = defaultdict(list)
    for m in matrices:
        ids = np.frombuffer(m.ids, "<u2").reshape(m.n_rows, sequence)
        positions = np.frombuffer(m.positions, "<u2").reshape(m.n_rows, sequence)
        assert m.n_rows == len(m.cu_seqlens) == len(m.doc_ids) == len(m.doc_starts)
        for row in range(m.n_rows):
            ends = m.cu_seqlens[row]
            assert ends[0] == 0 and ends[-1] <= sequence and len(ends) == len(m.doc_ids[row]) + 1
            assert not ids[row, ends[-1] :].any() and not positions[row, ends[-1] :].any()
            for a, b, doc, start in zip(ends[:-1], ends[1:], m.doc_ids[row], m.doc_starts[row], strict=True):
                assert positions[row, a:b].tolist() == list(range(b - a)) and b > a
                pieces[doc].append((start, tuple(ids[row, a:b].tolist())))
    return pieces


def test_nothing_is_lost(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(packing.MODEL))
    sequence = 128
    got = unpack(packing.pack(docs, sequence=sequence, matrix_rows=5).collect(), sequence)
    want = defaultdict(Counter)
    for r in rows:
        ids = library.encode(r[1] or "")
        for k in range(0, len(ids), sequence):
            want[r[0]][(k, tuple(ids[k : k + sequence]))] += 1
    assert {k: Counter(v) for k, v in got.items()} == dict(want)


def test_little_room_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    matrices = packing.pack(docs).collect()
    used = sum(ends[-1] for m in matrices for ends in m.cu_seqlens)
    assert used > 0.98 * sum(m.n_rows for m in matrices) * packing.SEQUENCE


def test_blocks_go_over_batches(spark, sf_dir):
    """Small batches and texts of both kinds fill sequences as one batch does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for rows in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found.append(sum(m.n_rows for m in packing.pack(docs).select("n_rows").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert abs(found[0] - found[1]) <= 2


def test_no_rows(nothing):
    assert packing.pack(nothing).collect() == []
