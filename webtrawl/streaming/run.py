"""Starting streams whose batches are handled by a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], None]


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as state processors must."""
    spark.conf.set(_STORE, _ROCKSDB)


def each_batch(
    stream: DataFrame, handle: Handler, checkpoint: str, every: str | None = "10 seconds"
) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; ``every=None`` takes what is there and stops.

    The checkpoint remembers the batch in progress; after a failure that batch
    is handed out again under the same number, so a handler that writes by
    batch number takes effect once.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def publish(
    messages: DataFrame,
    checkpoint: str,
    path: str | None = None,
    every: str | None = "10 seconds",
    **kafka: str,
) -> StreamingQuery:
    """Send a stream of (correlation_id, reply_to, body) on, and do not wait for answers.

    With ``path``, as JSON files, each message once; otherwise to the Kafka topic
    described by the options, keyed by the correlation id, ``reply_to`` as a
    header, at least once.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    if path is not None:
        writer = messages.writeStream.format("json").option("path", path)
    else:
        reply_to = F.struct(
            F.lit("reply_to").alias("key"), F.col("reply_to").cast("binary").alias("value")
        )
        records = messages.select(
            F.col("correlation_id").alias("key"),
            F.col("body").alias("value"),
            F.array(reply_to).alias("headers"),
        )
        writer = (
            records.writeStream.format("kafka").option("includeHeaders", "true").options(**kafka)
        )
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
