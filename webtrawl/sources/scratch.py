"""Scratch tables that cut lineage, and the size checks behind broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when both bounds were measured to hold.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables, as named by the cluster.

    ``spark.checkpoint.dir`` wins.  Only a local master may fall back to a
    folder of its own; a cluster without the setting is an error, as executors
    could not read each other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="webtrawl-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder of this application below the scratch folder."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result has no lineage to recompute, gives the same rows to every
    reader, survives lost executors, and carries real sizes for the optimizer.
    All tables of an application lie in one folder, to be dropped after it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, key: str) -> DataFrame:
    """Hint a broadcast of ``df`` after counting its rows and the bytes of ``key``.

    ``df`` should be a scratch table or a cheap scan, as it is read for the
    check.  Above the bounds ``df`` comes back unhinted and the join shuffles.
    """
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes"),
    ).first()
    return F.broadcast(df) if fits_broadcast(size["n"], size["bytes"]) else df
