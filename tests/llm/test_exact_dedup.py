"""Exact duplicates against a plain computation."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from webtrawl.llm import exact_dedup


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r[0])
    found = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            found[(i, keep, len(ids), kept, sha)] += 1
    return found


def test_report(docs, rows):
    got = Counter(tuple(r) for r in exact_dedup.report(docs).collect())
    assert got == expected(rows)


def test_a_full_filter_changes_nothing(docs, rows, monkeypatch):
    """With one block for thousands of rows every row may be shuffled."""
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", 1)
    many = docs.crossJoin(docs.sparkSession.range(300).withColumnRenamed("id", "n")).withColumn(
        "text", F.concat("text", F.lit(" "), "n")
    )
    got = exact_dedup.report(many)
    assert got.count() == len(rows) * 300
    assert got.where("kept").count() == many.select(exact_dedup.normalized()).distinct().count()


def test_only_possible_copies_are_shuffled(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3900).alias("text"))
    flagged = exact_dedup.flagged(docs)
    copies = flagged.where("maybe").count()
    assert 200 <= copies <= 600  # 100 pairs and a few false alarms
    twice = docs.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").count()
    assert twice == 100


def test_keep_one(docs, rows):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, plain(r.text)) for r in kept.collect())
    best = defaultdict(lambda: None)
    for r in rows:
        key = plain(r[1])
        best[key] = max((x for x in (best[key], r[0]) if x is not None), default=None)
    assert got == Counter((i, t) for t, i in best.items())


def test_no_rows(nothing):
    assert exact_dedup.report(nothing).collect() == []
    assert exact_dedup.keep_one(nothing).collect() == []


def test_main_path_is_native(docs):
    for df in (exact_dedup.report(docs), exact_dedup.keep_one(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
