"""Fingerprints against a plain computation, and each row with the right next one."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtrawl.llm import spotsigs


def test_chains_follow_anchors():
    signer = spotsigs.Signer(anchors=["the", "a"], chain=2)

    def of(text):
        sets, starts = signer([text])
        return set(sets[: starts[1]].tolist())

    # The same chain after the same anchor, whatever stands between that is common.
    one, two = of("q the cat a the sits"), of("zzz the cat the sits")
    assert len(one & two) >= 1
    assert of("The cat sits.") == of("the CAT sits")
    assert of("the cat sits") != of("a cat sits")
    assert of("") == of(" \n") == set()
    assert len(of("?!")) == 1 and of("?!") != of("!?")


def test_repeated_signatures_count():
    signer = spotsigs.Signer(anchors=["the"], chain=1)
    sets, starts = signer(["the cat the cat the cat", "the cat"])
    few, many = sets[starts[1] : starts[2]], sets[: starts[1]]
    assert set(few) < set(many) and len(many) > len(few)


def test_a_text_has_the_same_set_in_any_company(rows):
    signer = spotsigs.Signer()
    texts = [r[1] or "" for r in rows]
    sets, starts = signer(texts)
    for k, text in enumerate(texts):
        alone, _ = signer([text])
        assert alone.tolist() == sets[starts[k] : starts[k + 1]].tolist()
        assert (np.diff(alone.astype(np.int64)) > 0).all()
        assert len(alone) > 0 or not text.strip()


def test_jaccard():
    a, b = np.array([1, 2, 3, 4], np.uint32), np.array([3, 4, 5], np.uint32)
    assert spotsigs.jaccard(a, b) == 2 / 5
    assert spotsigs.jaccard(a, b, least=0.8) == 0.0  # ruled out by the sizes
    none = np.array([], np.uint32)
    assert spotsigs.jaccard(none, none) == 1.0 and spotsigs.jaccard(a, none) == 0.0


def in_order(rows):
    def hashes(spark):
        frame = spark.createDataFrame([(k, r[1] or "") for k, r in enumerate(rows)], "k int, text string")
        return {r.k: r.h for r in frame.select("k", F.xxhash64("text").alias("h")).collect()}

    return hashes


@pytest.mark.parametrize("range_bytes", [1 << 30, 3000])
def test_neighbours(spark, docs, rows, monkeypatch, range_bytes):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", range_bytes)
    hashes = in_order(rows)(spark)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0), hashes[k]))
    signer, want = spotsigs.Signer(), []
    signs = lambda t: signer([t])[0]
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = rows[k][1] or "", rows[after][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, other = signs(text), signs(edited), signs(following)
        want.append(
            (
                rows[k][0],
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                "".join(f"{s:08x}" for s in own),
                "".join(f"{s:08x}" for s in changed),
                spotsigs.jaccard(own, changed),
                spotsigs.jaccard(own, other),
            )
        )
    got = [tuple(r) for r in spotsigs.neighbours(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("near", [0.3, 0.8])
def test_search_finds_every_like_fingerprint(spark, sf_dir, docs, near):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    every = given.unionByName(docs.select("doc_id", "text"))
    rows = spotsigs.neighbours(every).select("doc_id", "fingerprint", "edited_fingerprint").collect()
    known = spotsigs.fingerprints(every)
    asked = [r.edited_fingerprint for r in rows] + [r.fingerprint for r in rows if (r.doc_id or 0) % 10 == 0]
    got = spotsigs.search(spark.createDataFrame([(a,) for a in asked], "fingerprint string"), known, near)

    def cut(text):
        return frozenset(text[k : k + 8] for k in range(0, len(text), 8))

    sets = {r.fingerprint: cut(r.fingerprint) for r in rows}
    assert {r.fingerprint for r in known.collect()} == set(sets)
    want = {}
    for a in set(asked):
        own = cut(a)
        for f, s in sets.items():
            likeness = len(own & s) / len(own | s) if own | s else 1.0
            if likeness >= near:
                want[a, f] = likeness
    assert {(r.query, r.fingerprint): r.likeness for r in got.collect()} == pytest.approx(want)


def test_one_row_is_its_own_next(spark):
    got = spotsigs.neighbours(spark.createDataFrame([(4, "the old cat sat")], "doc_id int, text string")).first()
    assert got.near_next == 1.0 and got.n_chars == 15


def test_no_rows(nothing):
    assert spotsigs.neighbours(nothing).collect() == []
    none = spotsigs.fingerprints(nothing)
    assert none.collect() == [] and spotsigs.search(none, none).collect() == []


def test_edited_texts_are_nearer_than_others(spark, sf_dir):
    found = spotsigs.neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    row = found.agg(
        F.percentile_approx("near_edited", 0.1).alias("edited"), F.percentile_approx("near_next", 0.9).alias("next")
    ).first()
    assert row.edited > 0.3 and row.next < 0.1
    assert re.fullmatch("([0-9a-f]{8})*", found.first().fingerprint)
