"""A state table kept as one folder of changes for each micro-batch.

A batch writes only what it changed, and writing a batch again replaces its
folder: a batch that is retried after a failure leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Batch numbers of a stream start at 0; rows from before it come first.
START = -1

# A read goes back over at most so many batches and one snapshot of those before.
SNAPSHOT_BATCHES = 20
_SNAPSHOTS = "-snapshots"


@dataclass(frozen=True)
class ChangeTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: Sequence[str] = ()

    def start(self, rows: DataFrame | None = None) -> ChangeTable:
        """Write the rows known before the first batch, or none."""
        first = self.spark.createDataFrame([], self.schema) if rows is None else rows
        self.write(first, START)
        return self

    def write(self, rows: DataFrame, batch_id: int) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        typed.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All changes with their ``batch``, or those of the batches before one."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        stored = self.spark.read.schema(schema).parquet(self.path)
        return stored if before is None else stored.where(F.col("batch") < before)

    def snapshot(self, before: int) -> None:
        """Write the state that the batches before ``before`` leave.

        Later reads begin there, so that they read a bounded number of batches
        however long the history is.  Writing one again replaces it.
        """
        stored = self.current(before)
        stored.write.mode("overwrite").parquet(f"{self.path}{_SNAPSHOTS}/before={before}")

    def snapshot_if_due(self, batch_id: int) -> None:
        """A snapshot every ``SNAPSHOT_BATCHES`` batches."""
        if batch_id > 0 and batch_id % SNAPSHOT_BATCHES == 0:
            self.snapshot(batch_id)

    def _snapshots(self) -> DataFrame | None:
        place = f"{self.path}{_SNAPSHOTS}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return None
        schema = T.StructType([*self.schema.fields, T.StructField("before", T.LongType())])
        return self.spark.read.schema(schema).parquet(place)

    def _since_snapshot(self, before: int | None) -> DataFrame:
        """The newest snapshot before a batch, as its last batch, and the batches after it."""
        snapshots = self._snapshots()
        if snapshots is not None and before is not None:
            snapshots = snapshots.where(F.col("before") <= before)
        newest = None if snapshots is None else snapshots.agg(F.max("before")).first()[0]
        if newest is None:
            return self.rows(before)
        names = self.schema.fieldNames()
        kept = snapshots.where(F.col("before") == newest)
        later = self.rows(before).where(F.col("batch") >= newest)
        return kept.select(*names, (F.col("before") - 1).alias("batch")).unionByName(later)

    def current(self, before: int | None = None) -> DataFrame:
        """The newest row of each key."""
        others = [n for n in self.schema.fieldNames() if n not in self.key]
        return (
            self._since_snapshot(before)
            .groupBy(*self.key)
            .agg(F.max_by(F.struct(*others), "batch").alias("_row"))
            .select(*[F.col(n) if n in self.key else F.col("_row")[n].alias(n) for n in self.schema.fieldNames()])
        )

    def compacted(self, path: str) -> ChangeTable:
        """The same table at a new place, its history folded into the rows before the first batch.

        For a stream that is stopped: its next batch then reads only these.
        """
        return ChangeTable(self.spark, path, self.schema, self.key).start(self.current())
