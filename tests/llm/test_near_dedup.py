"""Near duplicates: draws, similarities and classes against plain computations."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from webtrawl.llm import near_dedup
from webtrawl.operators.components import components
from webtrawl.llm.words import WordHasher


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def likeness(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def classes_of(texts, near=0.8):
    """Class of each text by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(texts)):
        for j in range(k):
            if likeness(sets[k], sets[j]) >= near:
                parent[max(root(k), root(j))] = min(root(k), root(j))
    return [root(k) for k in range(len(texts))]


def test_words():
    hasher = WordHasher()
    texts = ["One two, one", "", "...", "two_2 x", "日本 été", "one"]
    hashes, starts = hasher(texts)
    found = [hashes[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    assert [len(f) for f in found] == [3, 0, 0, 2, 2, 1]
    assert found[0][0] == found[0][2] == found[5][0] and found[0][1] != found[3][0]
    long = "a" * 300 + " " + "b" * 70_000
    assert len(hasher([long])[0]) == 2


def test_shingles_as_plain(rows):
    texts = [r[1] or "" for r in rows if "　" not in (r[1] or "")]
    features = near_dedup.Shingler()(texts)
    for k, text in enumerate(texts):
        counts = features.counts[features.starts[k] : features.starts[k + 1]]
        assert sorted(counts.tolist()) == sorted(shingles(text).values()), text[:50]


def test_draws_agree_as_often_as_texts_are_similar():
    draw = np.random.default_rng(3)
    shingle = np.sort(draw.integers(0, 1 << 44, 400).astype(np.uint64))
    sampler = near_dedup.Sampler(draws=3000)
    one, two = slice(0, 300), slice(60, 400)
    weight = draw.uniform(0.5, 3, 400)
    other = weight.copy()
    other[100:140] *= 2
    features = near_dedup.Features(
        np.concatenate([shingle[one], shingle[two]]), np.ones(640, int), np.array([0, 300, 640])
    )
    draws = sampler(features, np.concatenate([weight[one], other[two]]))
    a, b = np.zeros(400), np.zeros(400)
    a[one], b[two] = weight[one], other[two]
    assert abs((draws[0] == draws[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_profiles_never_rule_out_similar_texts():
    texts = near_copies()
    features = near_dedup.Shingler()(texts)
    weights = features.counts * 1.1
    profiles = near_dedup._as_profiles(pa.array(near_dedup._profiles(features, weights)))
    total = np.diff(np.concatenate([[0], np.cumsum(weights)])[features.starts])
    sets = [shingles(t) for t in texts]
    ruled_out = 0
    for k in range(len(texts)):
        able = near_dedup._can_be_near(profiles, total, profiles[k], total[k], 0.8)
        near = np.array([likeness(sets[k], s) >= 0.8 for s in sets])
        assert able[near].all()
        ruled_out += (~able).sum()
    assert ruled_out > 0.9 * sum(likeness(a, b) < 0.75 for a in sets for b in sets)


def test_components(spark):
    draw = random.Random(8)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x int, y int"), "x", "y").collect()}
    parent = {}

    def root(k):
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    for x, y in pairs:
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    linked = {n for p in pairs for n in p if p[0] != p[1]}
    assert {n: got.get(n, n) for n in linked} == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "x int, y int"), "x", "y").collect() == []


def check_classes(got, ids, texts):
    """Same classes as by all pairs, no link lost."""
    by_class = defaultdict(list)
    for i, c in zip(ids, classes_of(texts)):
        by_class[c].append(i)
    want = {}
    for members in by_class.values():
        named = [m for m in members if m is not None]
        for m in members:
            want.setdefault(m, []).append((min(named) if named else None, len(members)))
    have = defaultdict(list)
    for r in got:
        have[r.id].append((r.class_id, r.class_size))
    key = lambda x: (x[0] is None, x)
    assert {k: sorted(v, key=key) for k, v in have.items()} == {k: sorted(v, key=key) for k, v in want.items()}


def test_awkward_rows(docs, rows):
    got = near_dedup.classes(docs).collect()
    check_classes(got, [r[0] for r in rows], [r[1] for r in rows])


def near_copies():
    """Chains and stars of edited texts, and texts that share half of their words."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(12):
            edited = list(base)
            edited[draw.randrange(120)] = word()
            texts.append(" ".join(edited))
        for _ in range(6):  # a chain, each a step from the one before
            base = base[8:] + [word() for _ in range(8)]
            texts.append(" ".join(base))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]
    return texts


@pytest.mark.parametrize("meeting", [1024, 3])
def test_near_copies(spark, monkeypatch, meeting):
    monkeypatch.setattr(near_dedup, "MEETING", meeting)
    texts = near_copies()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_dedup.classes(rows).collect()
    check_classes(got, list(range(len(texts))), texts)


def test_keep_one(docs, rows):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = near_dedup.classes(docs)
    assert kept.count() == found.select("root").distinct().count()
    got = {r.class_id for r in found.collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == got


def test_no_rows(nothing):
    assert near_dedup.classes(nothing).collect() == []
    assert near_dedup.keep_one(nothing).collect() == []
