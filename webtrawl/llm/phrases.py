"""Collocations: phrases whose words meet more often than chance would have them.

The counts come from suffix subtrees that are cut off at the depth of the longest
phrase.  Word prefixes are partitioned by a memory budget, so that the suffixes
of each group of prefixes fit a task, which builds its subtrees without the others:

1. Words are read once, into blocks of ids with a table of each block's own words.
   Their counts by language give frequent words an id, by falling count.
2. A prefix with more suffixes than a part of the budget is split by its next word,
   as often as needed.  Words below that are packed into groups by running totals
   of their counts; the extensions of split prefixes go to groups by hash.
3. A block's suffixes, cut at the first infrequent word, are sorted and merged, and
   their runs go to the groups.  A group merges its runs into sorted suffixes with
   counts, the leaves of its subtrees, and a node's count is the sum of its leaves.

A phrase never occurs more often than its parts, so nothing that could reach the
count asked for is left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.llm.common import broadcast_if_measured, empty_if_null, quoted
from webtrawl.operators.ordered import number_rows, rank_rows
from webtrawl.sources.scratch import materialize

LONGEST = 5
LEAST = 100
BEST = 2_000
NO_LANGUAGE = "und"

# Suffixes of a group, which a task holds; a prefix with an eighth of that is split.
GROUP_SUFFIXES = 2_000_000

# Words of a block, and bytes of text that are split into words at a time.
BLOCK_WORDS = 1_000_000
TEXT_BYTES = 4_000_000

# Words whose counts are added up before running totals carry on.
SLICE = 4_096

# Characters that end a piece, and that part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

# No byte of UTF-8, so it can stand for the end of a piece among the words.
_END = b"\xff"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + PIECE_ENDS, bytes(range(97, 123)) + _END * len(PIECE_ENDS)
)
_CUT = re.compile(b"[" + re.escape(PIECE_ENDS + BLANKS) + b"]")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case, pieces parted by a mark."""
    return text.translate(_TABLE).replace(_END, b" " + _END + b" ").split()


def _portions(text: bytes) -> Iterator[bytes]:
    """A text in parts of about TEXT_BYTES that end between words."""
    start = 0
    while len(text) - start > TEXT_BYTES:
        cut = _CUT.search(text, start + TEXT_BYTES)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones: the high bytes of small ids are all 0."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


# --- Blocks ---------------------------------------------------------------------

BLOCKS = pa.schema(
    [("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
     ("ids", pa.binary()), ("own", pa.int64()), ("size", pa.int64())]
)
BLOCKS_DDL = "lang string, words array<binary>, counts array<bigint>, ids binary, own bigint, size bigint"


class Block:
    """Words of one language as ids of the block's own table, where 0 ends a piece."""

    def __init__(self):
        self.table: dict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.table[_END]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def take(self, lang: str, ahead: int) -> pa.RecordBatch:
        """The block as a row, and what is left begins with its last ``ahead`` words.

        These are in the row too, where phrases of its own words may end, but only
        the ``own`` ones before are counted.
        """
        ids = np.concatenate(self.parts)
        own = len(ids) - ahead
        words = list(self.table)
        counts = np.bincount(ids[:own], minlength=len(words))
        counts[0] = 0
        # Ids by falling count, so that most are small.
        order = np.argsort(-counts[1:], kind="stable") + 1
        place = np.zeros(len(words), np.int32)
        place[order] = np.arange(1, len(words))
        row = {
            "lang": lang, "words": [words[k] for k in order], "counts": counts[order],
            "ids": pa.compress(_planes(place[ids].astype("<i4")), "zstd", asbytes=True), "own": own, "size": len(ids),
        }
        rest = [words[k] for k in ids[own:]]
        self.__init__()
        self.add(rest)
        return pa.RecordBatch.from_pylist([row], BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[str, Block] = defaultdict(Block)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            block = open_[lang]
            for part in _portions(text.as_buffer().to_pybytes()):
                block.add(words_of(part))
                if block.size > 2 * BLOCK_WORDS:
                    # A block may end within a text: the phrases that begin in it are its own.
                    yield block.take(lang, LONGEST - 1)
            block.add([_END])
            if sum(b.size for b in open_.values()) > BLOCK_WORDS:
                largest = max(open_, key=lambda k: open_[k].size)
                yield open_.pop(largest).take(largest, 0)
    for lang, block in open_.items():
        yield block.take(lang, 0)


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(block, lang, words, counts, ids, own, size): the words of all texts, by language."""
    slim = docs.select(
        F.coalesce(quoted(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        empty_if_null(quoted(text)).alias("text"),
    )
    found = slim.mapInArrow(_blocks, BLOCKS_DDL)
    # Numbered as it is written, since block numbers must not change.
    return materialize(found.withColumn("block", F.monotonically_increasing_id()), "blocks")


def word_counts(found: DataFrame) -> DataFrame:
    """(lang, word, n) of all blocks."""
    each = found.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counts = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    return materialize(counts, "words")


def with_global_ids(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(block, ids, own, size, known): blocks with the pairs (own id, id) of their frequent words.

    Written out, as the blocks are moved for it and read more than once.
    """
    each = found.select("block", "lang", F.posexplode("words").alias("place", "word"))
    pair = F.struct((F.col("place") + 1).alias("own"), "id")
    names = broadcast_if_measured(frequent.select("lang", "word", "id"))
    maps = each.join(names, ["lang", "word"]).groupBy("block").agg(
        F.collect_list(pair).alias("known")
    )
    return materialize(found.select("block", "ids", "own", "size").join(maps, "block"), "named")


# --- Suffixes -------------------------------------------------------------------


def _suffixes(row: dict, longest: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of a block, sorted, and how often each occurs.

    Rows of ids padded with 0, cut at pieces' ends and infrequent words; those of
    one word are left out, as words are counted already.
    """
    ids = _from_planes(pa.decompress(row["ids"], 4 * row["size"], "zstd", asbytes=True), np.dtype("<i4"))
    known = row["known"]
    names = np.zeros(int(ids.max(initial=0)) + 1, kind)
    place, name = (known.field(k).to_numpy() for k in (0, 1))
    names[place] = name
    flat = np.concatenate([names[ids], np.zeros(longest, kind)])
    own = row["own"]
    at = np.flatnonzero((flat[:own] > 0) & (flat[1 : own + 1] > 0))
    rows = np.zeros((len(at), longest), kind)
    open_ = np.ones(len(at), bool)
    for k in range(longest):
        column = flat[at + k]
        open_ &= column > 0
        rows[:, k] = np.where(open_, column, 0)
    return merged(rows, np.ones(len(at), np.int64))


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts[order], at)


def nodes_of(rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth of the sorted rows' tree: depth, first row of each node, sum of its leaves."""
    new = np.zeros(len(rows), bool)
    if len(rows):
        new[0] = True
    for k in range(rows.shape[1]):
        new[1:] |= rows[1:, k] != rows[:-1, k]
        here = np.flatnonzero(rows[:, k] > 0)
        if not len(here):
            return
        # Rows that end above a depth begin nothing there.
        at = np.flatnonzero(new[here])
        yield k + 1, here[at], np.add.reduceat(counts[here], at)


def _hashed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the first ``sizes`` ids of each row."""
    found = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        step = (found ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        step ^= step >> np.uint64(29)
        found = np.where(k < sizes, step * np.uint64(0xD6E8FEB86659FD93), found)
    return found ^ (found >> np.uint64(32))


class Partition:
    """Which group each suffix belongs to."""

    def __init__(self, bounds: list[int], split: dict[int, np.ndarray], hashed: int):
        # bounds: the first id of each group of whole words; split: prefixes of k words.
        self.bounds, self.hashed = np.array(bounds, np.int64), max(1, hashed)
        self.split = {k: _hashed(p, np.full(len(p), k)) for k, p in sorted(split.items()) if len(p)}

    def split_depth(self, rows: np.ndarray) -> np.ndarray:
        """The length of the longest split prefix of each row.

        By hashes: a prefix that is taken for another is split, too, and its sums
        are put together like those of all split ones.
        """
        depth = np.zeros(len(rows), np.int64)
        for k, prefixes in self.split.items():
            here = np.flatnonzero((depth == k - 1) & (rows[:, k - 1] > 0))
            found = _hashed(rows[here], np.full(len(here), k))
            depth[here[np.isin(found, prefixes)]] = k
        return depth

    def __call__(self, rows: np.ndarray, block: int) -> np.ndarray:
        depth = self.split_depth(rows)
        length = (rows > 0).sum(axis=1)
        group = np.searchsorted(self.bounds, rows[:, 0].astype(np.int64), "right") - 1
        mark = _hashed(rows, np.minimum(depth + 1, length))
        # A suffix that ends with its split prefix is a partial sum wherever it goes.
        mark = np.where(length == depth, mark + np.uint64(block), mark)
        spread = len(self.bounds) + (mark % np.uint64(self.hashed)).astype(np.int64)
        return np.where(depth > 0, spread, group)


def _depth_table(rows: list, depth: int) -> np.ndarray:
    return np.array(sorted(r.ids for r in rows if len(r.ids) == depth), np.int64).reshape(-1, depth)


def split_prefixes(named: DataFrame, words: DataFrame, limit: int, longest: int, kind: str) -> dict[int, np.ndarray]:
    """By length, all prefixes with ``limit`` suffixes, and none with less than half as many.

    Blocks state the prefixes they hold at least an even share of half the limit
    of; one that has the limit does so in some block, and loses less than half.
    """
    first = words.where(F.col("n") >= limit).select(F.array("id").alias("ids")).collect()
    if not first:
        return {1: _depth_table([], 1)}
    heavy = np.array(sorted(r.ids[0] for r in first), np.int64)
    share = max(1, limit // (2 * max(1, named.select("block").count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            rows, counts = _suffixes(row, longest, np.dtype(kind))
            begins = np.isin(rows[:, 0], heavy)
            rows, counts = rows[begins], counts[begins]
            for depth, at, n in nodes_of(rows, counts):
                much = n >= share
                if depth > 1 and much.any():
                    yield pa.record_batch(
                        {"ids": pa.array(list(rows[at[much], :depth].astype(np.int64))), "n": pa.array(n[much])}
                    )

    stated = named.mapInArrow(run, "ids array<bigint>, n bigint")
    found = stated.groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= limit / 2).select("ids").collect()
    return {d: _depth_table(first + found, d) for d in range(1, longest + 1)}


def word_groups(words: DataFrame, limit: int, budget: int) -> list[int]:
    """The first id of each group of words that are not split, packed by running totals.

    A group closes before it passes the budget, so one list entry stands for
    about that many suffixes.
    """
    light = words.where(F.col("n") < limit).withColumn("slice", F.floor(F.col("id") / SLICE))
    # One row for each slice of words: the window without partitions is over these.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = light.groupBy("slice").agg(F.sum("n").alias("_n")).select(
        "slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("slice").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_before") + F.sum("n").over(within)
    running = light.join(F.broadcast(carried), "slice").withColumn("group", F.floor((total - 1) / (budget - limit)))
    return sorted(r["first"] for r in running.groupBy("group").agg(F.min("id").alias("first")).collect())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one; their pairs stay in Arrow."""
    for batch in batches:
        for k in range(len(batch)):
            yield {
                "block": batch.column("block")[k].as_py(), "ids": batch.column("ids")[k].as_buffer(),
                "own": batch.column("own")[k].as_py(), "size": batch.column("size")[k].as_py(), "known": batch.column("known")[k].values,
            }


RUNS_DDL = "group bigint, n bigint, data binary"
NODES_DDL = "ids array<bigint>, n bigint, part boolean"


def _packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    data = b"".join(_planes(column) for column in (*rows.T, counts.astype("<u4")))
    return pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, longest: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    size = n * kind.itemsize
    raw = pa.decompress(data, size * longest + 4 * n, "zstd", asbytes=True)
    columns = [_from_planes(raw[k * size : (k + 1) * size], kind) for k in range(longest)]
    return np.stack(columns, axis=1), _from_planes(raw[longest * size :], np.dtype("<u4")).astype(np.int64)


def frequent_phrases(
    named: DataFrame, words: DataFrame, least: int, longest: int, budget: int = GROUP_SUFFIXES
) -> DataFrame:
    """(ids, n): all phrases of 2 to ``longest`` words that occur ``least`` times.

    ``named`` is from :func:`with_global_ids`, ``words`` has the frequent words'
    id and n.
    """
    size = words.agg(F.coalesce(F.max("id"), F.lit(0)).alias("ids"), F.sum("n").alias("n")).first()
    kind = "<u4" if size["ids"] < 1 << 32 else "<u8"
    limit = max(1, budget // 8)
    split = split_prefixes(named, words, limit, longest, kind)
    mass = words.where(F.col("n") >= limit).agg(F.sum("n")).first()[0] or 0
    parting = Partition(word_groups(words, limit, budget), split, math.ceil(2 * mass / budget))
    groups = len(parting.bounds) + parting.hashed

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            rows, counts = _suffixes(row, longest, np.dtype(kind))
            group = parting(rows, row["block"])
            order = np.argsort(group, kind="stable")
            rows, counts, group = rows[order], counts[order], group[order]
            at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            if not len(group):
                continue
            parts = [(int(group[a]), b - a, _packed(rows[a:b], counts[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            names, sizes, data = zip(*parts, strict=True)
            yield pa.record_batch(
                {"group": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int64()), "data": pa.array(data, pa.binary())}
            )

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent nodes of a group, and the partial sums of split prefixes."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data"), strict=True):
                parts.append(_unpacked(data.as_py(), n, longest, np.dtype(kind)))
        rows, counts = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        depths = parting.split_depth(rows)
        for depth, at, n in nodes_of(rows, counts):
            part = depths[at] >= depth
            wanted = (n >= least) | part
            if depth > 1 and wanted.any():
                yield pa.record_batch(
                    {
                        "ids": pa.array(list(rows[at[wanted], :depth].astype(np.int64))),
                        "n": pa.array(n[wanted]),
                        "part": pa.array(part[wanted]),
                    }
                )

    runs = named.mapInArrow(deal, RUNS_DDL).repartition(groups, "group")
    found = materialize(runs.groupBy("group").applyInArrow(subtrees, NODES_DDL), "nodes")
    sums = found.where("part").groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialize(found.where("NOT part").select("ids", "n").unionByName(sums), "phrases")


# --- Scores ---------------------------------------------------------------------


def _without_longer(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one holds as often.

    A longer one that occurs as often does so through one with a word more.
    """
    size = F.size("ids")
    parts = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    above = (
        phrases.where(size > 2).select(F.explode(parts).alias("part"), "n")
        .groupBy("part").agg(F.max("n").alias("most"))
    )
    joined = phrases.join(above, F.col("ids") == F.col("part"), "left")
    return joined.where(F.col("most").isNull() | (F.col("most") < F.col("n"))).select("ids", "n")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), in whole numbers of up to 38 digits."""
    whole = "decimal(38,0)"
    above = (a.cast("decimal(20,0)") * n.cast("decimal(18,0)")).cast(whole) * F.lit(1000)
    return F.call_function("div", above.cast(whole), (left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast(whole))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    best: int = BEST,
    budget: int = GROUP_SUFFIXES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Phrases have 2 to ``longest`` words within a piece of text and occur a >=
    ``least`` times in their language.  Cut in two, a phrase scores 1000 a n / (l r),
    rounded down, by the counts of its parts and of all words; its lowest score
    counts, and the first such cut.  Phrases inside one as frequent are left out.
    A null language is ``und``, a null text has no words.
    """
    found = blocks(docs, text, lang)
    counts = word_counts(found)
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = number_rows(counts.where(F.col("n") >= least), [F.desc("n"), "lang", "word"], "id")
    words = materialize(words, "frequent")
    named = with_global_ids(found, words)
    phrases = frequent_phrases(named, words, least, longest, budget)

    known = materialize(words.select(F.array("id").alias("ids"), "n").unionByName(phrases), "known")
    langs = words.join(broadcast_if_measured(totals), "lang").select(F.col("id").alias("word_id"), "lang", "total")
    kept = materialize(
        _without_longer(phrases).join(langs, F.col("ids")[0] == F.col("word_id")).drop("word_id"), "kept"
    )
    size = F.size("ids")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size)})
    l = known.select(F.col("ids").alias("left"), F.col("n").alias("l"))  # noqa: E741
    r = known.select(F.col("ids").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(l, "left").join(r, "right").withColumn(
        "score", score(F.col("n"), F.col("total"), F.col("l"), F.col("r"))
    )
    lowest = scored.groupBy("ids", "n", "lang", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = (
        lowest.select("*", F.posexplode("ids").alias("place", "word_id"))
        .join(words.select(F.col("id").alias("word_id"), "word"), "word_id")
        .groupBy("ids", "n", "lang", "total", "cut")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    )
    texts = materialize(
        spelled.select(
            "lang", F.array_join(F.transform("words", lambda x: x["word"].cast("string")), " ").alias("phrase"),
            F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score",
        ),
        "scored",
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = rank_rows(texts, ["lang"], order, "rank").where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
