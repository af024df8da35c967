"""The pipeline as a whole, and stage by stage against plain computations."""

from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from webtrawl.llm.sentencepiece_codec import MODEL
from webtrawl.sources.scratch import materialize


def test_stages(spark, docs, rows):
    frame, seen = materialize(docs, "docs"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = materialize(stage(spark, frame, None), name)
        if name != "tokens":
            assert found.columns == docs.columns
        seen[name], frame = found, found
    texts = {n: [r.text for r in f.select("text").collect()] for n, f in seen.items() if n != "tokens"}
    assert all(any(map(str.isalpha, t)) for t in texts["language"]) and len(texts["language"]) == len(rows) - 5
    lower = Counter(t.lower() if t.isascii() else t for t in texts["exact"])
    assert max(lower.values()) == 1
    assert set(texts["near"]) <= set(texts["exact"]) and set(texts["mixture"]) <= set(texts["near"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    ids = Counter(tuple(r.ids) for r in seen["tokens"].select("ids").collect())
    assert ids == Counter(tuple(library.encode(t)) for t in texts["mixture"])


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert 0 < found.select("doc_id").distinct().count() < docs.count()
    assert found.where("size(ids) != n_tokens").isEmpty()


def test_no_rows(spark, nothing):
    frame = nothing
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, None)
        assert frame.collect() == []
