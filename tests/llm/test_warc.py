"""Archives written and read back."""

import base64
import hashlib

from pyspark.sql import functions as F

from webtrawl.llm import warc
from webtrawl.sources.scratch import scratch_path

PAGES = [
    (1, "u", "é" * 50),
    (2, None, "é" * 50),
    (3, "u\r\nWARC-Type: revisit", None),
    (4, "", ""),
    (None, "n", "x\r\n\r\ny\n" * 9),
    (5, "v", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5),
    (6, "w", "a" * 7),
    (7, "w", "a" * 8),
    (1, "u", "é" * 50),
    (8, "é?q=<&>", "日本語\x00" * 40),
    (None, "m", "x\r\n\r\ny\n" * 9),
    (9, "long", "z" * 100_001),
    (9, None, "z" * 100_001),
    (10, "later", "z" * 100_001),
]


def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return frame.withColumns({c: F.lit("own") for c in ("data", "bytes", "digest", "row", "chunk", "first")})


def round_trip(spark, frame, chunk_bytes, least_bytes=0):
    path, mark = scratch_path(spark, "warc"), warc.new_mark()
    warc.write(warc.chunks(warc.records(frame, least_bytes=least_bytes), chunk_bytes), path, mark)
    return path, mark


def expected(least_bytes=0):
    first = {}
    for i, _, html in PAGES:
        payload = (html or "").encode()
        if i is not None:
            first[payload] = min(first.get(payload, i), i)
    found, responded = [], set()
    for i, _, html in PAGES:
        payload = (html or "").encode()
        refers = first.get(payload) if len(payload) >= least_bytes else None
        # Of the rows with the smallest page_id, one is the response.
        if refers == i and payload not in responded:
            responded.add(payload)
            refers = None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        found.append((i, "revisit" if refers is not None else "response", len(payload), digest, refers, True))
    return sorted(found, key=repr)


def checked(spark, path, mark):
    rows = warc.check(warc.read(spark, path, mark)).collect()
    number = lambda x: None if x in (None, "") else int(x)
    return sorted(
        ((number(r.page_id), r.type, r.bytes, r.digest, number(r.refers_to), r.intact) for r in rows), key=repr
    )


def test_round_trip(spark):
    for chunk_bytes in (7, 64, 1 << 20):
        assert checked(spark, *round_trip(spark, pages(spark), chunk_bytes)) == expected(), chunk_bytes


def test_small_payloads_are_written_out(spark):
    assert checked(spark, *round_trip(spark, pages(spark), 64, least_bytes=8)) == expected(8)


def test_chunks_are_bounded_and_carry_digests(spark):
    table = warc.chunks(warc.records(pages(spark)), 1000)
    assert table.agg(F.max(F.octet_length("data"))).first()[0] == 1000
    digest = hashlib.sha1()
    rows = table.where("page_id = 9").orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(101))
    for r in rows:
        digest.update(r.data)
        assert r.running == base64.b32encode(digest.digest()).decode()


def test_a_changed_byte_is_found(spark):
    path, mark = round_trip(spark, pages(spark), 50)
    table = warc.read(spark, path, mark)
    changed = table.withColumn(
        "data",
        F.when((F.col("page_id") == "9") & (F.col("chunk") == 3), F.lit(b"y" * 50)).otherwise(F.col("data")),
    )
    bad = warc.check(changed).where("not intact").collect()
    assert [r.page_id for r in bad] == ["9"]
    lost = warc.check(table.where("not (page_id = '9' and chunk = 3)")).where("not intact").collect()
    assert [r.page_id for r in lost] == ["9"]


def test_archives_are_warc(spark):
    """A plain reader of the format finds the same records."""
    path, mark = round_trip(spark, pages(spark).repartition(1), 1000)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/part-*").collect())
    seen = 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert fields["WARC-Record-ID"] and fields["WARC-Date"] and fields["WARC-Type"]
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
        seen += fields["WARC-Type"] != "continuation"
    assert seen == len(PAGES)


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert checked(spark, *round_trip(spark, none, 10)) == []
