"""The registered queries against their SQL, and what their contracts say."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from checks.compare import compare, oracle_connection
from webtrawl.llm.oracle import all_sql
from webtrawl.llm.queries import all_queries

COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    3: "doc_id size source_size target taken",
    6: "doc_id keep_id group_size kept text_sha256",
    7: "doc_id held_out lang_pred score",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id class_id",
    10: "page_id payload_bytes payload_digest record_type refers_to",
}


def test_one_query_for_each_operator():
    names = sorted(all_queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(all_sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_as_sql(spark, sf_dir, name):
    same, note = compare(spark, oracle_connection(sf_dir), sf_dir, all_queries()[name], all_sql()[name])
    assert same, note


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_columns_and_rows(spark, sf_dir, name):
    found = all_queries()[name](spark, sf_dir)
    wanted = COLUMNS.get(int(name[2:].split("_")[0]), "").split()
    assert found.columns[: len(wanted)] == wanted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if "doc_id" in found.columns:
        assert found.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        assert found.count() == docs.count()


def test_mix_comes_near_its_targets(spark, sf_dir):
    mixed = all_queries()["op3_mixing"](spark, sf_dir)
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= max(2, 0.01 * r.target)


def test_links_are_named_for_what_they_are(spark, sf_dir):
    """Only the links that built a class are counted, not all texts like a row's."""
    columns = all_queries()["op9_near_dedup"](spark, sf_dir).columns
    assert columns == ["doc_id", "class_id", "class_size", "links_used"]
