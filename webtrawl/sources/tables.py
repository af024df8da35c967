"""Stored tables: definition, scan, insert, and the document sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.operators.tables import assign_ids, validate
from webtrawl.schemas import DOCUMENTS, Table


def create_table(spark: SparkSession, table: Table, path: str) -> None:
    """Register ``table`` with its schema as a Parquet table at ``path``."""
    spark.catalog.createTable(table.name, path=path, source="parquet", schema=table.schema)


def scan(spark: SparkSession, table: Table, path: str) -> DataFrame:
    """The whole table; columns and filters used later reach the files."""
    return spark.read.schema(table.schema).parquet(path)


def insert(
    spark: SparkSession, table: Table, path: str, rows: DataFrame, order: Sequence[str | Column]
) -> tuple[DataFrame, DataFrame]:
    """Append the rows that keep the rules; gives (inserted with ids, refused).

    Ids follow the greatest one stored, in ``order``.
    """
    checked = validate(rows, table)
    refused = checked.where(F.col("violation").isNotNull())
    good = checked.where(F.col("violation").isNull()).drop("violation")
    if table.key:
        (key,) = table.key
        good = assign_ids(scan(spark, table, path), good.drop(key), key, order).withColumn(
            key, F.col(key).cast("int")
        )
    stored = good.select(*[f.name for f in table.fields])
    stored.write.mode("append").parquet(path)
    return stored, refused


def append_documents(documents: DataFrame, path: str) -> None:
    """Append (url, content); a url stored again keeps both versions."""
    documents.select(*DOCUMENTS.fieldNames(), "version").write.mode("append").parquet(path)
