"""JSON messages in and out, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.schemas import MESSAGE

ENVELOPE = T.StructType(
    [
        T.StructField("correlation_id", T.StringType()),
        T.StructField("reply_to", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)


def message_stream(spark: SparkSession, path: str | None = None, **kafka: str) -> DataFrame:
    """Messages as (correlation_id, reply_to, ts, body).

    With ``path``, JSON files of envelopes; otherwise a Kafka topic described by
    the options, its key read as the correlation id and its ``reply_to`` header.
    """
    if path is not None:
        return spark.readStream.schema(ENVELOPE).json(path)
    records = (
        spark.readStream.format("kafka").option("includeHeaders", "true").options(**kafka).load()
    )
    reply_to = F.filter("headers", lambda h: h["key"] == "reply_to")
    return records.select(
        F.col("key").cast("string").alias("correlation_id"),
        F.get(reply_to, F.lit(0))["value"].cast("string").alias("reply_to"),
        F.col("timestamp").alias("ts"),
        F.col("value").cast("string").alias("body"),
    )


def parse_messages(messages: DataFrame) -> DataFrame:
    """Adds ``message`` (the parsed body) and ``malformed``, true where it is not JSON."""
    schema = T.StructType([*MESSAGE.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_bad"})
    bad = F.col("message").isNull() | F.col("message._bad").isNotNull()
    return messages.withColumn("message", parsed).withColumn("malformed", bad)


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good messages, and the others as they came."""
    good = parsed.where(~F.col("malformed")).drop("malformed")
    return good, parsed.where(F.col("malformed")).drop("malformed", "message")


def task_fields() -> list[Column]:
    """domain, author_id and https of a crawl task, whichever shape it came in.

    In the second shape the flag says what the domain text leaves out.
    """
    bare = F.col("message.index.domain")
    scheme = F.when(F.col("message.index.https"), "https://").otherwise("http://")
    named = F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(scheme, bare))
    return [
        F.coalesce(F.col("message.data.domain"), named).alias("domain"),
        F.col("message.data.author_id").alias("author_id"),
    ]


def task_body(domain: Column, author_id: Column) -> Column:
    """The JSON text of a crawl task."""
    return F.to_json(
        F.struct(
            F.lit("crawl").alias("type"),
            F.struct(domain.alias("domain"), author_id.alias("author_id")).alias("data"),
        )
    )


def error_body(status: Column) -> Column:
    """The JSON text of a reply without data."""
    empty = F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(status.alias("status"), empty.alias("data")))


def reply_body(status: Column, data: Column) -> Column:
    """The JSON text of a reply; ``data`` is a struct, left empty unless the status is ok."""
    full = F.to_json(F.struct(status.alias("status"), data.alias("data")))
    return F.when(status == "ok", full).otherwise(error_body(status))


def append_json(messages: DataFrame, path: str) -> None:
    """Append a batch of messages as JSON files."""
    messages.write.mode("append").json(path)
