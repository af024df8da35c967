"""The trie against one built turn by turn, in one shard and in many."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from webtrawl.llm import turn_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, marks string, key string"


def brute_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def leaves(path):
        return sum(map(leaves, children.get(path, []))) or 1

    def saved(path):
        here = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        return here + sum(map(saved, children.get(path, [])))

    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs),
            len(children.get(path, [])), leaves(path), saved(path),
            sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def made(seed, convs, kinds, longest):
    draw = random.Random(seed)
    rows = []
    for k in range(convs):
        conv = draw.choice([k, 100 * (k % 7), 1000 + k])
        for turn in range(draw.randint(1, longest)):
            word = draw.randrange(kinds)
            rows.append((conv, turn, ["user", "assistant"][turn % 2], "é" * word + "x"))
    return rows


def found(spark, rows, shards):
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = turn_trie.nodes(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_same_as_turn_by_turn(spark, shards):
    rows = made(shards, 300, 2, 7)
    assert found(spark, rows, shards) == brute_force(rows)


def test_one_conversation_of_most_rows_spreads_over_shards(spark):
    """A third of the conversations are one, so that its nodes lie in many shards."""
    rows = made(5, 100, 3, 6)
    rows += [(5000 + k, t, "user", f"same {t}") for k in range(300) for t in range(8)]
    assert found(spark, rows, 16) == brute_force(rows)


def test_awkward_rows(spark):
    """Nulls, ties, repeated rows, long conversations, and some that become turnless."""
    rows = [
        (1, None, "user", "no number"), (1, 1, None, None), (1, 1, "b", "x"), (1, 1, "a", "y"), (1, 1, "a", "y"),
        (2, None, "user", "no number"), (None, 0, "user", "nobody"), (None, None, None, None),
        (100, 0, "user", ""), (101, 0, "user", "gone"), (102, 0, "user", ""), (3, 5, "user", "z" * 10_000),
    ]
    rows += [(7, t, "user", str(t % 3)) for t in range(150)] + [(8, t, "user", str(t % 3)) for t in range(151)]
    assert found(spark, rows, 5) == brute_force(rows)


def test_no_conversations(spark):
    assert found(spark, [], 3) == []


def test_rows_sort_by_their_ids():
    draw = np.random.default_rng(3)
    paths = [tuple(draw.integers(1, 3, draw.integers(0, 90))) for _ in range(200)]
    paths += [p[: len(p) // 2] for p in paths] + paths[:50]
    lengths = np.array([len(p) for p in paths])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    conv = draw.permutation(len(paths))
    order = turn_trie.sorted_rows(conv, np.concatenate(paths).astype(np.int64), starts[:-1], lengths)
    assert order.tolist() == sorted(range(len(paths)), key=lambda k: (paths[k], conv[k]))
