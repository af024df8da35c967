"""Exact duplicates by two passes over a Bloom filter.

Pass one sets two bits for each text in a blocked Bloom filter whose cells count
to two, and keeps the bits that were set at least twice.  Pass two looks each
text up: one of whose bits was set once has no copy and passes straight through;
only the rest, copies and a few false alarms, are shuffled on their SHA-256.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest doc_id stays, a null id being smallest.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, orderable, quoted
from webtrawl.sources.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bits of the filter for each row, two of which are set; bits of one block.
BITS_PER_ROW = 16
BLOCK_BITS = 32_768

# The filter is broadcast.  So many blocks of 4 KiB bound it at 128 MiB; beyond
# 67 million rows it fills up and lets more rows through to the shuffle.
MAX_BLOCKS = 32_768


def normalized(text: str = "text") -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    plain = empty_if_null(text)
    # lower() has a fast path for pure ASCII, where it changes A-Z alone.
    return F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(
        F.translate(plain, UPPER, LOWER)
    )


def text_sha256(text: str = "text") -> Column:
    return F.sha2(normalized(text), 256)


def block_count(rows: int) -> int:
    """Blocks of the filter: a power of two with BITS_PER_ROW for each row, within the bound."""
    wanted = max(1, rows * BITS_PER_ROW // BLOCK_BITS)
    return min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())


def _placed(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """``docs`` as a struct with the block and the two bits of each text."""
    mark = F.xxhash64(normalized(text))
    return docs.select(F.struct("*").alias("row"), mark.alias("mark")).select(
        "row",
        F.pmod("mark", F.lit(blocks)).alias("block"),
        F.shiftrightunsigned("mark", 20).bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("bit1"),
        F.shiftrightunsigned("mark", 40).bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("bit2"),
    )


def repeated_bits(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Pass one: the bits set twice or more, as one bitmap for each block that has any."""
    blocks = block_count(docs.count())
    bits = _placed(docs.select(quoted(text).alias("text")), "text", blocks).select(
        "block", F.explode(F.array("bit1", "bit2")).alias("bit")
    )
    twice = bits.groupBy("block", "bit").count().where("count >= 2")
    bitmaps = twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return materialize(bitmaps, "repeated-bits"), blocks


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.bit_get(byte.cast("bigint"), (bit % 8).cast("int")) == 1


def flagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pass two: (row, maybe); rows that are not ``maybe`` have no copy."""
    bitmaps, blocks = repeated_bits(docs, text)
    found = _placed(docs, text, blocks).join(F.broadcast(bitmaps), "block", "left")
    both = _is_set(F.col("bits"), F.col("bit1")) & _is_set(F.col("bits"), F.col("bit2"))
    return found.select("row", F.coalesce(both, F.lit(False)).alias("maybe"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: keep_id, group_size, kept and text_sha256.

    Rows that repeat one doc_id with one text count as copies; one of them stays.
    A group without any doc_id has a null keep_id, and one row of it stays.
    """
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    marked = flagged(slim).select(
        F.col("row.doc_id").alias("doc_id"), text_sha256("row.text").alias("text_sha256"), "maybe"
    )
    alone = marked.where(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    shuffled = materialize(
        marked.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n")),
        "candidates",
    )
    # Written out, so that the join may split the rows of one text over tasks.
    groups = materialize(
        shuffled.groupBy("text_sha256").agg(
            F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")
        ),
        "groups",
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    grouped = (
        shuffled.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
        .select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")
    )
    return alone.unionByName(grouped)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one whole row for each text, the one with the largest doc_id.

    Rows equal in doc_id and text are told apart by their other columns, the
    greatest staying.
    """
    marked = flagged(docs, text)
    total = F.struct(F.col("row")[doc_id], *[F.col("row")[c] for c in orderable(docs)])
    best = (
        marked.where("maybe")
        .groupBy(F.sha2(normalized(F.col("row")[text]), 256).alias("text_sha256"))
        .agg(F.max_by("row", total).alias("row"))
    )
    return marked.where(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))
