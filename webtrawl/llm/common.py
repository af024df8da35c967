"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.sources.scratch import fits_broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(*columns: str | Column) -> Column:
    """128 bits that stand for the values of ``columns``; nulls count as values."""
    marks = [F.col(c) if isinstance(c, str) else c for c in columns]
    marks = [part for c in marks for part in (c, c.isNull())]
    return F.struct(F.xxhash64(*marks).alias("a"), F.xxhash64(F.lit(7), *marks).alias("b"))


def orderable(df: DataFrame) -> list[str]:
    """Columns of ``df`` that have an order, for ties between whole rows."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind)
        return not isinstance(kind, T.MapType | T.VariantType)

    return [f.name for f in df.schema if ordered(f.dataType)]


def broadcast_if_measured(df: DataFrame) -> DataFrame:
    """Hint a broadcast of ``df``, a written table, after counting its rows and all their bytes."""
    size = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
    ).first()
    return F.broadcast(df) if fits_broadcast(size["rows"], size["bytes"]) else df


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
