"""Apportionment against its definition, and the mix as a whole."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from webtrawl.llm import mixing


def by_highest_quotients(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda k: (Fraction(votes[k]) / (2 * given[k] + 1), -k))
        given[k] += 1
    return given


def test_apportionment():
    draw = random.Random(2)
    for _ in range(300):
        votes = [draw.choice([0, 1, 5, draw.randrange(1, 400)]) for _ in range(draw.randrange(1, 8))]
        seats = draw.randrange(0, 60)
        want = by_highest_quotients(votes, seats) if sum(votes) else [0] * len(votes)
        assert mixing.apportion(votes, seats) == want


def test_targets_stop_and_share():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [Fraction(375, 2), 75, Fraction(75, 2)]
    # The first is full at 30, and the rest is shared 2 : 1.
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210) == [30, 120, 60]
    # The second is full only after the first.
    assert mixing.targets([10, 30, 200], [5, 2, 1], 240) == [30, 90, 120]
    assert mixing.targets([0, 5], [5, 2], 5) == [0, 5]
    assert mixing.targets([], [], 0) == []


def test_blocks_of_a_shard():
    draw = np.random.default_rng(1)
    for _ in range(200):
        sizes = draw.integers(1, 50, draw.integers(1, 30))
        block = int(draw.integers(1, 20))
        blocks = max(1, round(int(sizes.sum()) / block))
        quota = int(draw.integers(0, 4 * blocks))
        taken = mixing.take_blocks(sizes, quota, block, 3, 9)
        assert (taken >= 0).all() and (taken <= 3 * sizes).all()
        wanted = min(quota, 3 * blocks) * sizes.sum() / blocks
        assert abs(taken.sum() - wanted) <= blocks  # block sizes differ by a word
        assert (taken == mixing.take_blocks(sizes, quota, block, 3, 9)).all()


def test_whole_copies():
    draw = np.random.default_rng(3)
    for _ in range(200):
        sizes = draw.integers(1, 50, draw.integers(1, 30))
        words = draw.integers(0, 3 * sizes + 1)
        copies = mixing.whole_copies(sizes, words, 9)
        assert (copies >= words // sizes).all() and (copies <= -(-words // sizes)).all()
        assert abs((copies * sizes).sum() - words.sum()) < sizes.max()
        assert (copies == mixing.whole_copies(sizes, words, 9)).all()


def test_whole_copies_are_unbiased():
    sizes, words = np.array([1000, 400, 30, 2000]), np.array([300, 320, 50, 600])
    found = np.array([mixing.whole_copies(sizes, words, seed) for seed in range(4000)])
    assert found.mean(axis=0) == pytest.approx(words / sizes, abs=0.04)


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (r[0] is None, r[0] or 0, words(r[1])) for r in rows
    )
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sum(words(x[1]) for x in rows if x[3] == r.source)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], sum(sizes.values()))
    assert [target[s] for s in order] == pytest.approx([float(w) for w in want])
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in order)


def test_reruns_and_partitions_agree(docs):
    one = sorted(map(repr, mixing.mix(docs, shard_words=500).collect()))
    two = sorted(map(repr, mixing.mix(docs.repartition(7), shard_words=500).collect()))
    assert one == two


def test_resample(docs, rows):
    found = mixing.resample(docs)
    assert found.columns == docs.columns
    times = defaultdict(int)
    for r in found.collect():
        times[(r.doc_id, r.text, r.source)] += 1
    have = defaultdict(int)
    for r in rows:
        have[(r[0], r[1], r[3])] += 1
    assert set(times) <= set(have)
    assert all(n <= 3 * have[k] for k, n in times.items())


def test_kept_words_follow_targets(spark):
    """Long documents, and a tiny source that makes blocks of one word."""
    draw = random.Random(4)
    rows = [(k, "w " * draw.randrange(1_500, 4_500), "abc"[k % 3]) for k in range(450)]
    rows += [(1_000 + k, "few words here", "tiny") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = {r.source: r.target for r in mixing.mix(frame).collect()}
    kept, longest = defaultdict(int), defaultdict(int)
    for r in mixing.resample(frame).collect():
        kept[r.source] += words(r.text)
    for _, text, source in rows:
        longest[source] = max(longest[source], words(text))
    assert target["tiny"] == 180 == kept["tiny"]
    assert set(kept) == set(target)
    # Two or three shards a source, each less than one document off.
    assert all(abs(kept[s] - target[s]) <= 0.02 * target[s] + longest[s] for s in target), (kept, target)


def test_repeated_rows_are_told_apart(spark):
    """Rows equal but for another column share what their words get; equal ones too."""
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text, "a", k // 2) for k in range(400)] + [(k, text + " more", "b", k) for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, other int")
    target = {r.source: r.target for r in mixing.mix(frame, weights=(1, 2)).collect()}
    assert target["a"] < 0.8 * 4000
    for bound in (1_000_000, 100):
        found = mixing.resample(frame, weights=(1, 2), task_rows=bound).collect()
        kept = sum(words(r.text) for r in found if r.source == "a")
        assert abs(kept - target["a"]) <= 20
        assert len({r.other for r in found if r.source == "a"}) >= kept // 20


def test_no_rows(nothing):
    assert mixing.mix(nothing).collect() == []
    assert mixing.resample(nothing).collect() == []
