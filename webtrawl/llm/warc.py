"""WARC archives written and read as a table of chunks.

A payload longer than a chunk becomes a segmented record: its first segment and
continuation records, each one row of record identifier and chunk number with a
digest of all bytes so far.  Every row is a whole WARC record of bounded size, so
neither writing nor reading holds a whole payload, and the archives are ordinary
files of Spark's text sink and source on any file system.

The first field of every record is a mark drawn for the archive.  With it, the
version line is a line separator that no payload holds, so that archives are read
in parallel, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, quoted
from webtrawl.sources.scratch import broadcast_if_small, materialize

CHUNK_BYTES = 1 << 20

# Payloads of fewer bytes are always written out.
LEAST_REVISIT_BYTES = 0

_END = "\r\n\r\n"
_HEX, _BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def new_mark() -> str:
    return uuid.uuid4().hex


def _record_start(mark: str) -> str:
    return f"WARC/1.1\r\nWARC-Archive-Mark: {mark}\r\n"


def base32_sha1(data: str | Column) -> Column:
    """SHA-1 in base32: five hexadecimal digits are four of base32."""
    digits = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.lower(F.concat(*parts)), _HEX, _BASE32)


def _urn(page_id: Column) -> Column:
    """The record identifier of a page; one without an id is ``<urn:page:>``."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, null where ``value`` is; line ends inside become blanks."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "))


def _lines(*fields: Column) -> Column:
    return F.concat(F.concat_ws("\r\n", *fields), F.lit(_END))


def records(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = LEAST_REVISIT_BYTES,
) -> DataFrame:
    """(page_id, url, data, bytes, digest, refers_to): ``refers_to`` is null for responses.

    Of equal payloads the smallest page_id is the response, and the others are
    revisits of it; a null id is largest.  Where several rows have that page_id,
    one with the smallest url (null first) is the response and the others revisit
    it, too.  Where no row has a page_id, all are responses, as there is nothing to
    refer to.  A null payload is empty.
    """
    slim = pages.select(
        quoted(page_id).alias("page_id"),
        quoted(url).cast("string").alias("url"),
        empty_if_null(quoted(payload).cast("string")).cast("binary").alias("data"),
    ).withColumns({"bytes": F.octet_length("data"), "digest": base32_sha1("data")})
    # By page_id first: twins are the rows that share the smallest one.
    by_page = slim.where(F.col("bytes") >= least_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    counted = by_page.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.sum("n").alias("n"), F.min_by("n", "page_id").alias("twins")
    )
    repeated = materialize(counted.where("n > 1").select("digest", "first", "twins"), "repeated")
    found = slim.join(broadcast_if_small(repeated, "digest"), "digest", "left")
    is_first = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    is_twin = F.coalesce(is_first & (F.col("twins") > 1) & (F.col("bytes") >= least_bytes), F.lit(False))
    columns = ["page_id", "url", "data", "bytes", "digest"]
    plain = found.where(~is_twin).select(
        *columns, F.when(~is_first & (F.col("bytes") >= least_bytes), F.col("first")).alias("refers_to")
    )
    if repeated.where("twins > 1").isEmpty():
        return plain
    # Equal twins are counted, one row for each url, before one of them is chosen.
    twins = materialize(
        found.where(is_twin)
        .groupBy("page_id", "url", "digest", "bytes")
        .agg(F.any_value("data").alias("data"), F.count(F.lit(1)).alias("n")),
        "twins",
    )
    chosen = twins.groupBy("digest").agg(F.min(F.struct("url")).alias("response"))
    each = twins.join(chosen, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    responds = (F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("response.url"))
    return plain.unionByName(each.select(*columns, F.when(~responds, F.col("page_id")).alias("refers_to")))


def chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``records``: their columns, row, chunk (from 0), chunks, running.

    ``data`` is the chunk's bytes and ``running`` the digest of the payload up to
    its end.  Revisits have one empty chunk.
    """
    revisit = F.col("refers_to").isNotNull()
    number = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes)))
    rows = rows.withColumns(
        {
            "row": F.monotonically_increasing_id(),
            "chunks": number.cast("int"),
            "data": F.when(revisit, F.lit(b"")).otherwise(F.col("data")),
        }
    )
    whole = rows.where("chunks = 1").withColumns({"chunk": F.lit(0), "running": F.col("digest")})
    # The chunks of a row follow each other, so one digest runs through them.
    cut = rows.where("chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("data", F.substring("data", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    pieces = cut.mapInArrow(_running, f"{kinds}, running string")
    return whole.unionByName(pieces)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = hashlib.sha1()
    for batch in batches:
        found = []
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            if chunk == 0:
                digest = hashlib.sha1()
            digest.update(data.as_buffer())
            found.append(base64.b32encode(digest.digest()).decode())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "running"]
        )


def write(table: DataFrame, path: str, mark: str, date: Column | None = None) -> None:
    """Write a chunk table as WARC archives into the folder ``path``, a file for each partition."""
    first, last = F.col("chunk") == 0, F.col("chunk") == F.col("chunks") - 1
    revisit, cut = F.col("refers_to").isNotNull(), F.col("chunks") > 1
    own = _urn(F.col("page_id"))
    http = _lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        _field("Content-Length", F.col("bytes")),
    )
    http = F.when(first, http).otherwise("")
    segment = F.concat(F.lit("<urn:segment:"), F.col("row"), F.lit(":"), F.col("chunk") + 1, F.lit(">"))
    stamp = F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = _lines(
        F.concat(
            F.lit(_record_start(mark) + "WARC-Type: "),
            F.when(~first, "continuation").when(revisit, "revisit").otherwise("response"),
        ),
        _field("WARC-Record-ID", F.when(first, own).otherwise(segment)),
        _field("WARC-Date", stamp),
        _field("WARC-Target-URI", F.col("url")),
        _field("Content-Type", F.when(first, "application/http;msgtype=response")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _field("WARC-Segment-Number", F.when(cut, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, own)),
        _field("WARC-Segment-Total-Length", F.when(cut & last, F.col("bytes") + F.octet_length(http))),
        _field("Segment-Row", F.when(cut, F.col("row"))),
        _field("Segment-Count", F.when(cut, F.col("chunks"))),
        _field("Segment-Running-Digest", F.when(cut, F.concat(F.lit("sha1:"), "running"))),
        _field("Content-Length", F.octet_length(http) + F.octet_length("data")),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), F.col("data"), F.lit(b"\r\n\r"))
    # The text sink writes the bytes as they are, and the last line feed itself.
    table.select(record.cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """The chunk table of the archives in ``path``.

    (page_id string, type, bytes, digest, refers_to string, row, chunk, chunks,
    running, data); ``digest`` and ``bytes`` are what the first record states.
    """
    lines = spark.read.option("lineSep", _record_start(mark)).text(path).where("value != ''")
    head = F.substring_index("value", _END, 1)
    is_first = ~F.col("type").eqNullSafe("continuation")

    def field(name: str, pattern: str = "([^\r\n]*)") -> Column:
        found = F.regexp_extract(head, f"(?:^|\r\n){name}: {pattern}", 1)
        return F.when(found != "", found)

    named = lines.select(
        "value",
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("own"),
        field("WARC-Segment-Origin-ID", "<urn:page:([^>]*)>").alias("origin"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers"),
        field("WARC-Payload-Digest", "sha1:(.*)").alias("digest"),
        field("Segment-Row").cast("bigint").alias("row"),
        F.coalesce(field("WARC-Segment-Number").cast("int") - 1, F.lit(0)).alias("chunk"),
        F.coalesce(field("Segment-Count").cast("int"), F.lit(1)).alias("chunks"),
        field("Segment-Running-Digest", "sha1:(.*)").alias("running"),
        field("Content-Length").cast("int").alias("length"),
        (F.octet_length(head) + 4).alias("begin"),
    )
    http = F.when(is_first, F.octet_length(F.substring_index("value", _END, 2)) + 4 - F.col("begin"))
    stated = F.regexp_extract(F.substring_index("value", _END, 2), "(?s)\r\n\r\n.*\r\nContent-Length: ([0-9]+)", 1)
    named = named.withColumns(
        {"http": F.coalesce(http, F.lit(0)), "bytes": F.when(is_first, stated.cast("bigint"))}
    )
    data = F.substring(
        F.col("value").cast("binary"), F.col("begin") + F.col("http") + 1, F.col("length") - F.col("http")
    )
    return named.select(
        F.url_decode(F.coalesce("own", "origin")).alias("page_id"),
        "type", "bytes", "digest",
        F.url_decode("refers").alias("refers_to"),
        "row", "chunk", "chunks", "running",
        data.alias("data"),
    )


def check(table: DataFrame) -> DataFrame:
    """(page_id, type, bytes, digest, refers_to, intact), one row for each record of a chunk table.

    Digests and lengths are those of the payloads as read.  Whole payloads are
    digested in place; only chunks are sorted together, and one digest runs
    through the chunks of each record.  A revisit's are what it states.
    """
    columns = ["page_id", "type", "bytes", "digest", "refers_to"]
    found = F.when(F.col("type") == "revisit", F.col("digest")).otherwise(base32_sha1("data"))
    size = F.when(F.col("type") == "revisit", F.col("bytes")).otherwise(F.octet_length("data"))
    whole = table.where("chunks = 1").withColumns({"found": found, "size": size.cast("bigint")})
    whole = whole.withColumn("intact", F.col("found").eqNullSafe(F.col("digest")))
    pieces = (
        table.where("chunks > 1")
        .repartition("row")
        .sortWithinPartitions("row", "chunk")
        .mapInArrow(
            _joined,
            "page_id string, type string, refers_to string, found string, size bigint, intact boolean",
        )
    )
    names = ["page_id", "type", "refers_to", "found", "size", "intact"]
    both = whole.select(*names).unionByName(pieces.select(*names))
    return both.select("page_id", "type", F.col("size").alias("bytes"), F.col("found").alias("digest"), "refers_to", "intact")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record of chunks in order, which may go on in the next batch."""
    digest, size, expected, intact, first = hashlib.sha1(), 0, 0, True, {}
    for batch in batches:
        done = []
        data = batch.column("data")
        for k, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
            if row["chunk"] == 0:
                digest, size, expected, intact, first = hashlib.sha1(), 0, 0, True, row
            digest.update(data[k].as_buffer())
            size += len(data[k].as_buffer())
            running = base64.b32encode(digest.digest()).decode()
            intact &= row["chunk"] == expected and running == row["running"]
            expected += 1
            if row["chunk"] == row["chunks"] - 1:
                intact &= running == first.get("digest") and size == first.get("bytes")
                done.append(
                    {
                        "page_id": row["page_id"],
                        "type": first.get("type"),
                        "refers_to": None,
                        "found": running,
                        "size": size,
                        "intact": bool(intact),
                    }
                )
        yield pa.RecordBatch.from_pylist(done, _RECORD)


_RECORD = pa.schema(
    [
        ("page_id", pa.string()),
        ("type", pa.string()),
        ("refers_to", pa.string()),
        ("found", pa.string()),
        ("size", pa.int64()),
        ("intact", pa.bool_()),
    ]
)
