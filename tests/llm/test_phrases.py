"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtrawl.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, word string, ids string, n string"


def brute_force(rows, least, longest, best):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for d in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + d])) for i in range(len(words) - d + 1))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    found, held = [], set()
    for (lang, words), a in candidates.items():
        parts = {words[i : i + d] for d in range(2, len(words)) for i in range(len(words) - d + 1)}
        held |= {(lang, p) for p in parts if a >= f[lang, p]}
    for (lang, words), a in candidates.items():
        if (lang, words) in held:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]  # noqa: E741
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        found.append((lang, " ".join(words), a, l, r, total[lang], score))
    ranked = []
    for lang in total:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(own[:best], 1)]
    return sorted(ranked)


def text_of(draw, words, kinds):
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]
    return "".join(draw.choice(["Ab", "b", "the", "OF", "é", "x-1", "w"][:kinds]) + draw.choice(ends) for _ in range(words))


def found(spark, rows, least, longest=5, best=2_000, budget=phrases.GROUP_SUFFIXES, parts=3):
    frame = spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA).repartition(parts)
    got = phrases.collocations(frame, least=least, longest=longest, best=best, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("budget", [phrases.GROUP_SUFFIXES, 400, 40])
def test_same_as_counting(spark, budget):
    """With one group, with many, and where most prefixes are split to the last word."""
    draw = random.Random(budget)
    rows = [(k, text_of(draw, draw.randrange(60), 7), ["en", "de", None][k % 3]) for k in range(120)]
    wanted = brute_force(rows, 4, 5, 2_000)
    assert len(wanted) > 100
    assert found(spark, rows, 4, budget=budget) == wanted


def test_hot_phrase_and_few_best(spark):
    """One passage of five words in a third of the texts, all of whose prefixes are split."""
    draw = random.Random(3)
    rows = [(k, text_of(draw, 30, 7) + ". one hot passage of words" * 5, "en") for k in range(60)]
    wanted = brute_force(rows, 5, 5, 7)
    assert len(wanted) == 7
    assert found(spark, rows, 5, best=7, budget=80, parts=8) == wanted


def test_awkward_rows(spark, rows):
    """Nulls, empty texts, upper case, letters beyond A-Z, repeated rows."""
    slim = [(r[0], r[1], r[2]) for r in rows] * 2 + [(1, "ÀB ÀB c\x00d ÀB", "und"), (1, "ÀB ÀB", None)]
    wanted = brute_force(slim, 2, 5, 2_000)
    assert wanted
    assert found(spark, slim, 2) == wanted


def test_texts_longer_than_a_block(spark, monkeypatch):
    """A text over many portions and blocks loses no phrase at their edges."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 40)
    draw = random.Random(9)
    rows = [(k, text_of(draw, 700, 4), "en") for k in range(3)] + [(9, "a" * 500, "en")]
    assert found(spark, rows, 6) == brute_force(rows, 6, 5, 2_000)


def test_nothing(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(1, None, None), (2, ".,;", "en"), (3, "one two", "en")], 2) == []


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 10**12, 10**14, 3 * 10**12, 7 * 10**12  # noqa: E741
    frame = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    got = frame.select(phrases.score(*[F.col(c) for c in "anlr"])).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_groups_hold_the_budget(spark):
    """Word groups are packed by running totals, and every prefix above the limit is split."""
    counts = [5_000, 900, 700, 90, 80] + [20] * 300
    words = spark.createDataFrame(
        [("en", b"w%d" % k, n, k + 1) for k, n in enumerate(counts)], "lang string, word binary, n bigint, id bigint"
    )
    bounds = phrases.word_groups(words, 100, 800)
    sums = np.add.reduceat(counts, np.array(bounds) - 1)
    assert bounds[0] == 4 and sums.max() <= 800 and len(bounds) <= 2 * sum(counts[3:]) / 700 + 1
