"""Mixture inference against a plain one, on mixed texts, and on held-out documents."""

import math

import numpy as np

from pyspark.sql import functions as F

from webtrawl.llm import language_id
from webtrawl.llm.queries import op7_language_id
from webtrawl.llm.words import Characters, letter

LETTERS = Characters(letter)


def test_cells_of_letters_only():
    one = language_id.cells_of("Ab, c!", LETTERS)
    assert one.tolist() == language_id.cells_of("aB 12 C", LETTERS).tolist()
    assert len(one) == 4  # " ab", "ab ", "b c", " c "
    for blank in ("", " ", "12 ...", "½ ²"):
        assert len(language_id.cells_of(blank, LETTERS)) == 0


def test_proportions_are_the_best():
    draw = np.random.default_rng(5)
    cells = draw.dirichlet(np.ones(30), 2)
    counts = draw.multinomial(4000, 0.3 * cells[0] + 0.7 * cells[1])
    weights, reached = language_id.proportions(cells, counts)
    by_grid = max(float(counts @ np.log(w * cells[0] + (1 - w) * cells[1])) for w in np.linspace(0.001, 0.999, 999))
    assert math.isclose(reached, by_grid, rel_tol=1e-6) and abs(weights[0] - 0.3) < 0.06


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = op7_language_id(spark, sf_dir)
    got = found.join(docs, "doc_id").where("held_out")
    assert got.count() > 20
    assert got.where("lang_pred != lang").count() <= 0.02 * got.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_mixed_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    longest = {
        r.lang: r.text
        for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()
    }
    text = longest["en"][:3000] + "\n" + longest["de"][:1500]
    found = language_id.infer(model, language_id.cells_of(text, LETTERS))
    assert found.languages == ["en", "de"]
    assert abs(found.weights[0] - 2 / 3) < 0.1


def test_awkward_rows(docs, rows):
    model = language_id.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    got = language_id.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        has_letter = any(map(str.isalpha, r.text or ""))
        assert (r.found.lang == "und") == (not has_letter)
        assert 0 <= r.found.score <= 1 and abs(sum(r.found.weights) - has_letter) < 1e-6


def test_only_labelled_rows_teach(docs):
    assert language_id.learn(docs.where("lang = 'fr'")).languages == ["fr"]
    nobody = language_id.learn(docs.where("lang is null"))
    assert nobody.languages == []
    got = language_id.predict(docs.select("text"), nobody).collect()
    assert {r.found.lang for r in got} == {"und"} and {r.found.score for r in got} == {0.0}


def test_rejected_documents(docs, rows):
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.select("text").collect()]
    assert all(any(map(str.isalpha, t)) for t in texts)
    gone = len(rows) - len(texts)
    assert gone == 5  # two nulls and three texts without a letter


def test_strange_letters(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language_id, "SMOOTHING", 1e-4)  # as in a corpus a thousand times larger
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    for text, known in (("日本語のテキストです", False), ("the cat", True), ("zzqxj qxzzj", False), ("und", True)):
        assert language_id.infer(model, language_id.cells_of(text, LETTERS)).known == known, text
    assert language_id.keep_known(docs).count() == docs.count()


def test_no_rows(nothing):
    assert language_id.keep_known(nothing).collect() == []
