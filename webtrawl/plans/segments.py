"""An index that grows: each batch of documents is a segment of its own.

A segment holds the documents, postings and term counts of its batch, and the urls
it replaces or deletes in the segments before it.  Its counts are differences: what
the replaced documents had is taken off, so that counts of a term, of documents and
of tokens are plain sums over segments.  Segments are read in the order of a
manifest, a small table with a folder for each version; a batch or a merge counts
once its version is written, and a version once written is never changed.

Neighbouring segments of one order of size are merged when there are enough of them,
so there are only some segments of each order, and a document is written anew
once for each order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.operators.search import bm25, document_frequency, idf, page_of_hits, postings_hits, tokenise
from webtrawl.plans.index import Index, documents_of, write_postings
from webtrawl.plans.search import query_terms
from webtrawl.sources.scratch import broadcast_if_small
from webtrawl.streaming.run import Handler

# So many neighbours of one order of size become one segment, so many times as large.
FAN = 4

MANIFEST = T.StructType(
    [
        T.StructField("place", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("held", T.LongType()),
        T.StructField("documents", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Segment:
    """A segment: documents it holds, and by how many documents and tokens it changes the corpus.

    ``batch`` is the last batch of a stream that is in it, -1 for none.
    """

    name: str
    batch: int
    held: int
    documents: int
    tokens: int


@dataclass(frozen=True)
class SegmentedIndex:
    """An index of segments below ``path``."""

    spark: SparkSession
    path: str
    buckets: int

    def start(self) -> SegmentedIndex:
        """Write the manifest of an index without segments."""
        self._commit([], 0)
        return self

    def _commit(self, segments: Sequence[Segment], version: int) -> None:
        rows = [(k, s.name, s.batch, s.held, s.documents, s.tokens) for k, s in enumerate(segments)]
        schema = T.StructType(MANIFEST.fields[:-1])
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={version}"
        )

    def manifest(self) -> tuple[int, list[Segment]]:
        """The newest version, and its segments, oldest first.

        The manifest has a row for each segment of each version, a few for each batch.
        """
        # Versions in a folder's name only: one without segments has no row.
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # A version whose writer was lost has no success mark.
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath() for s in files.listStatus(root)]
        done = [int(p.getName().split("=")[1]) for p in names if files.exists(mark(p, "_SUCCESS"))]
        version = max(done)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").where(F.col("version") == version)
        found = sorted(rows.collect(), key=lambda r: r.place)
        return version, [Segment(r.name, r.batch, r.held, r.documents, r.tokens) for r in found]

    def part(self, segment: Segment) -> Index:
        return Index(self.spark, f"{self.path}/{segment.name}", self.buckets)

    def _live(self, segments: Sequence[Segment], read) -> DataFrame:
        """``read(segment)`` of all segments, without urls that a later segment replaces.

        The lists of replaced urls are measured before they are broadcast.
        """
        parts, replaced = [], None
        for segment in reversed(segments):
            rows = read(self.part(segment))
            if replaced is not None:
                rows = rows.join(broadcast_if_small(replaced, "url"), "url", "left_anti")
            parts.append(rows)
            own = self.part(segment).table("replaced")
            replaced = own if replaced is None else replaced.unionByName(own)
        return reduce(DataFrame.unionByName, parts)

    def documents(self, segments: Sequence[Segment] | None = None) -> DataFrame:
        """(url, tokens, n_tokens) of the documents as they are now."""
        segments = self.manifest()[1] if segments is None else segments
        return self._live(segments, lambda part: part.table("documents"))

    def append(self, documents: DataFrame, deleted: DataFrame | None = None, batch: int = -1) -> None:
        """Add a segment with (url, content), replacing documents of the same url.

        ``documents`` has one row for each url; ``deleted`` (url) are dropped.  No
        older segment is written; of older ones, only the documents replaced are read
        for their counts.  A ``batch`` that is in the index already is not added again.
        """
        version, segments = self.manifest()
        if batch >= 0 and any(s.batch >= batch for s in segments):
            return
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        part = Index(self.spark, f"{self.path}/{name}", self.buckets)
        tokenise(documents).write.parquet(f"{part.path}/documents")
        stored = part.table("documents")
        gone = stored.select("url") if deleted is None else stored.select("url").unionByName(deleted.select("url"))
        gone.distinct().write.parquet(f"{part.path}/replaced")
        counts, after = document_frequency(stored), _corpus(stored)
        documents_change, tokens_change = after
        if segments:
            urls = broadcast_if_small(part.table("replaced"), "url")
            self.documents(segments).join(urls, "url", "left_semi").write.parquet(f"{part.path}/before")
            before = part.table("before")
            counts = counts.unionByName(
                document_frequency(before).select("term", (-F.col("documents")).alias("documents"))
            )
            counts = counts.groupBy("term").agg(F.sum("documents").alias("documents")).where("documents <> 0")
            less = _corpus(before)
            documents_change, tokens_change = after[0] - less[0], after[1] - less[1]
        write_postings(stored, counts, part)
        segments.append(Segment(name, batch, after[0], documents_change, tokens_change))
        self._commit(segments, version + 1)

    def merge(self, fan: int = FAN) -> int:
        """Merge the oldest run of ``fan`` neighbours of one order of size; how many went into one.

        Nothing is merged, and 0 given, where there is no such run.  Segments merged
        are not read any more and can be dropped when no reader is left.
        """
        version, segments = self.manifest()
        orders = [int(math.log(max(1, s.held), fan)) for s in segments]
        run = next(
            (k for k in range(len(segments) - fan + 1) if len(set(orders[k : k + fan])) == 1), None
        )
        if run is None:
            return 0
        group = segments[run : run + fan]
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        part = Index(self.spark, f"{self.path}/{name}", self.buckets)
        self.documents(group).write.parquet(f"{part.path}/documents")
        parts = [self.part(s) for s in group]
        union = [p.table("replaced") for p in parts]
        reduce(DataFrame.unionByName, union).distinct().write.parquet(f"{part.path}/replaced")
        counts = reduce(DataFrame.unionByName, [p.table("terms").select("term", "documents") for p in parts])
        counts = counts.groupBy("term").agg(F.sum("documents").alias("documents")).where("documents <> 0")
        stored = part.table("documents")
        write_postings(stored, counts, part)
        merged = Segment(
            name,
            max(s.batch for s in group),
            stored.count(),
            sum(s.documents for s in group),
            sum(s.tokens for s in group),
        )
        self._commit([*segments[:run], merged, *segments[run + fan :]], version + 1)
        return fan

    def search(self, q: str, size: int, start: int = 0) -> DataFrame:
        """One page of (url, score) for the phrase ``q``, as on an index built anew.

        Reads the folders of its terms in each segment, and the replaced urls.
        """
        _, segments = self.manifest()
        terms = query_terms(self.spark, q)
        none = self.spark.createDataFrame([], "url string, score double")
        if not terms or not segments:
            return none
        # A row for each term of the phrase and segment.
        counts: dict[str, int] = {}
        for segment in segments:
            for row in self.part(segment).of_terms("terms", terms).collect():
                counts[row["term"]] = counts.get(row["term"], 0) + row["documents"]
        if any(counts.get(t, 0) <= 0 for t in terms):
            return none
        corpus = sum(s.documents for s in segments)
        mean_length = sum(s.tokens for s in segments) / corpus
        weight = sum((idf(F.lit(counts[t]), corpus) for t in terms), F.lit(0.0))
        found = self._live(segments, lambda part: part.of_terms("postings", terms).drop("bucket"))
        score = bm25(weight, F.col("frequency"), F.col("n_tokens"), mean_length)
        return page_of_hits(postings_hits(found, terms).select("url", score.alias("score")), size, start)


def _corpus(documents: DataFrame) -> tuple[int, int]:
    row = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    return row["n"], row["tokens"]


def index_handler(index: SegmentedIndex, fan: int = FAN) -> Handler:
    """Adds a batch of pages (url, html, ts) as a segment, and merges where it is due.

    Of a url that comes twice in a batch the newest page counts, the greatest of
    equally new ones; a null html deletes its url.  A batch that runs again is not
    added twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("url").agg(F.max(F.struct("ts", F.col("html").isNotNull(), "html")).alias("p"))
        newest = newest.select("url", F.col("p.html").alias("html"))
        pages = documents_of(newest.where(F.col("html").isNotNull()))
        index.append(pages, newest.where(F.col("html").isNull()).select("url"), batch_id)
        while index.merge(fan):
            pass

    return handle
