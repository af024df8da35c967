"""Row verbs, table rules and stored tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.operators import tables
from webtrawl.schemas import CRAWLER_STATS, USERS, Table, compose, integer, text
from webtrawl.sources import tables as stored

NOW = datetime(2024, 1, 1, 10)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", 10), (2, "b", None), (3, "a", 30), (4, None, 10)]
    return spark.createDataFrame(rows, "id int, name string, age int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filter(people):
    assert rows_of(tables.filter_rows(people, name="a", age=10)) == [(1, "a", 10)]
    assert rows_of(tables.filter_rows(people, name=None)) == []
    with pytest.raises(ValueError):
        tables.filter_rows(people)


def test_get(people):
    assert tables.get_row(people, ["id"], name="a").id == 1
    with pytest.raises(tables.DoesNotExist):
        tables.get_row(people, ["id"], name="z")


def test_get_rows(spark, people):
    lookups = spark.createDataFrame([("a",), ("z",)], "name string")
    assert rows_of(tables.get_rows(lookups, people, ["name"], "id")) == [("a", 1, 10, True), ("z", None, None, False)]


def test_update_leaves_null_comparisons(people):
    got = rows_of(tables.update_rows(people, {"name": "x"}, age=10))
    assert got == [(1, "x", 10), (2, "b", None), (3, "a", 30), (4, "x", 10)]


def test_delete_keeps_null_comparisons(people):
    assert [r[0] for r in rows_of(tables.delete_rows(people, name="a"))] == [2, 4]
    assert [r[0] for r in rows_of(tables.delete_rows(people, name=None))] == [1, 2, 3, 4]


def test_delete_by_key(spark, people):
    keys = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id int")
    assert [r[0] for r in rows_of(tables.delete_by_key(people, keys, ["id"]))] == [2, 3, 4]


def test_upsert(spark, people):
    changes = spark.createDataFrame(
        [(1, "old", 1, 1), (1, "new", 2, 2), (9, "nine", None, 1)], "id int, name string, age int, v int"
    )
    got = rows_of(tables.upsert(people, changes, ["id"], ["v"]))
    assert got == [(1, "new", 2), (2, "b", None), (3, "a", 30), (4, None, 10), (9, "nine", None)]


def test_validate(spark):
    rows = [("d" * 255, "s", 1, None, NOW), ("d" * 256, None, 1, 1, NOW), ("é" * 255, "s", None, 0, NOW), ("d", "s", 1, 0, None)]
    df = spark.createDataFrame(rows, "domain string, status string, author_id int, https int, time timestamp_ntz")
    got = [(r.https, r.pages_count, r.violation) for r in tables.validate(df, CRAWLER_STATS).collect()]
    assert got == [
        (0, 0, None),
        (1, 0, "domain: incorrrect str size"),
        (0, 0, "author_id: field value is none but required"),
        (0, 0, "time: field value is none but required"),
    ]


def test_schema_compose():
    base = Table("base", (integer("id", key=True), text("name", 10)))
    table = compose("sub", [base], text("name", 99), integer("age", required=False, default=3))
    assert table.schema == T.StructType(
        [
            T.StructField("name", T.StringType(), False),
            T.StructField("age", T.IntegerType(), True),
            T.StructField("id", T.IntegerType(), True),
        ]
    )
    assert {f.name: f.size for f in table.fields}["name"] == 10
    assert table.key == ["id"]


def test_table_definition(spark, tmp_path):
    stored.create_table(spark, USERS, str(tmp_path / "users"))
    try:
        assert spark.table("Users").schema.fieldNames() == USERS.schema.fieldNames()
        assert spark.table("Users").count() == 0
    finally:
        spark.sql("DROP TABLE Users")


def test_table_insert(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.createDataFrame([(7, "e", "n", NOW, NOW)], USERS.schema).write.parquet(path)
    rows = spark.createDataFrame(
        [("b@x", "b", NOW, NOW), ("a@x", "a", NOW, NOW), ("c@x", None, NOW, NOW), ("d" * 33, "d", NOW, NOW)],
        "email string, name string, created_date timestamp_ntz, last_login_date timestamp_ntz",
    )
    inserted, refused = stored.insert(spark, USERS, path, rows, ["email"])
    assert sorted((r.id, r.name) for r in inserted.collect()) == [(8, "a"), (9, "b")]
    assert {r.violation for r in refused.collect()} == {
        "name: field value is none but required",
        "email: incorrrect str size",
    }
    assert sorted(r.id for r in stored.scan(spark, USERS, path).collect()) == [7, 8, 9]


def test_index_sink(spark, tmp_path):
    from webtrawl.sources.pages import newest_versions

    path = str(tmp_path / "documents")
    for version, content in ((1, "old"), (2, "new")):
        df = spark.createDataFrame([("u", content, version)], "url string, content string, version int")
        stored.append_documents(df, path)
    documents = spark.read.parquet(path)
    assert documents.count() == 2
    assert [r.content for r in newest_versions(documents, "version").collect()] == ["new"]


def test_assign_ids(spark, people):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    got = tables.assign_ids(people, rows, "id", ["k"]).orderBy("k").collect()
    assert [r.id for r in got] == list(range(5, 505))
    empty = people.where("false")
    assert tables.assign_ids(empty, rows, "id", ["k"]).agg(F.min("id")).first()[0] == 1
