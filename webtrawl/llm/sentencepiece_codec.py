"""SentencePiece encoding through tables of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character, so
no merge crosses the boundary before a run of markers.  A text therefore falls
into chunks (a run of markers and what follows it) that can be segmented one by
one.  A task takes its texts in blocks, makes the table of the distinct chunks of
a block, has the library segment each of them once, and joins the ids back by
position.

The table is made for each block.  Sharing one table over all tasks would mean
sending every text, or every position of every text, through a shuffle to where
its chunks' ids are: more bytes than the corpus, to save segmenting a rare chunk
anew in another block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from webtrawl.llm.common import quoted
from webtrawl.llm.words import slices_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"

# Characters of a block, or one longer text.  A block takes some 20 bytes for each.
BLOCK_CHARS = 4_000_000

# Chunks that go through the library in one call.
CALL_CHUNKS = 1_000

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Encodes blocks of texts; a chunk is named by what follows its first marker."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        self.marked = np.array([piece.startswith(MARK) for piece in pieces])
        # Chunks that the library decodes to something else than themselves.
        self.odd: dict[str, str] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one place more)."""
        chunks, starts = _flat_chunks(texts)
        table = chunks.dictionary_encode()
        at = table.indices.to_numpy()
        ids, sizes = self.segment(table.dictionary.to_pylist())
        entry = pa.LargeListArray.from_arrays(_ends(sizes), pa.array(ids))
        return entry.take(table.indices).flatten().to_numpy(), _ends(sizes[at])[starts]

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``chunks`` end to end, and how many each has."""
        if any(MARK in c for c in chunks) or "" in chunks:
            # Chunks of several markers, one by one.
            lists = [self.library.encode(c.replace(MARK, " ")) for c in chunks]
            # An empty string has no ids, a lone marker has one.
            lists = [x or [self.library.piece_to_id(MARK)] for x in lists]
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(chain.from_iterable(lists), np.int32)
        else:
            # A chunk's first id, and no other, begins with a marker.
            calls = [
                self.library.encode(" ".join(chunks[k : k + CALL_CHUNKS]))
                for k in range(0, len(chunks), CALL_CHUNKS)
            ]
            ids = np.fromiter(chain.from_iterable(calls), np.int32)
            first = np.flatnonzero(self.marked[ids])
            sizes = np.diff(np.append(first, len(ids)))
        plain = " ".join(chunks).replace(MARK, " ")
        # All at once first; chunk by chunk only where that differs.
        if self.library.decode(ids.tolist()) != plain:
            ends = _ends(sizes)
            for k, c in enumerate(chunks):
                decoded = self.library.decode(ids[ends[k] : ends[k + 1]].tolist())
                if decoded != c.replace(MARK, " "):
                    self.odd[c] = decoded
        return ids, sizes

    def decoded(self, text: str) -> str:
        """What the library decodes the ids of ``text`` to, once they have been found."""
        if self.odd:
            chunks = _split(text)
            if not self.odd.keys().isdisjoint(chunks):
                return " ".join([self.odd.get(c, c.replace(MARK, " ")) for c in chunks])
        return text.replace(MARK, " ")


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _is_plain(text: str) -> bool:
    """Whether each space of ``text`` begins a chunk of its own."""
    return not (MARK in text or "  " in text or text[:1] == " " or text[-1:] == " ")


def _split(text: str) -> list[str]:
    """The chunks of a text, which gets a marker in front, without their first marker."""
    if not text:
        return []
    if _is_plain(text):
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


def _flat_chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts end to end, and where each text's begin."""
    if "" not in texts and all(map(_is_plain, texts)):
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        return lists.flatten(), lists.offsets.to_numpy()
    lists = [_split(text) for text in texts]
    flat = pa.array(list(chain.from_iterable(lists)), pa.large_string())
    return flat, _ends(np.array([len(x) for x in lists]))


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters, one text at least.

    Texts that need the slow way (empty, or with runs of spaces) lie together.
    """
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def in_two(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of ``texts`` with their places, plain texts apart from the others."""
    apart: tuple[list[int], list[int]] = ([], [])
    for k, text in enumerate(texts):
        apart[text == "" or not _is_plain(text)].append(k)
    for places in apart:
        for start, end in blocks([texts[k] for k in places]):
            yield places[start:end], [texts[k] for k in places[start:end]]


def encode_digests(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    model: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and its ids if asked for.

    A null text counts as empty: no ids, and the digests of an empty string.
    Repeated rows and ids give one row each.
    """
    path = model or public_tokenizers.path(MODEL)
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        # Each id in decimal, a comma after it.
        names = pa.array([f"{i}," for i in range(encoder.library.vocab_size())], pa.large_string())
        for batch in chain.from_iterable(slices_of(b, "text", BLOCK_CHARS) for b in batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = np.zeros(len(texts), np.int64)
            digests: list[str] = [""] * len(texts)
            decoded: list[str] = [""] * len(texts)
            kept: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            for places, part in in_two(texts):
                ids, starts = encoder.encode(part)
                tokens[places] = np.diff(starts)
                written = names.take(pa.array(ids))
                ends = np.frombuffer(written.buffers()[1], np.int64, len(ids) + 1)
                letters = memoryview(written.buffers()[2] or b"")
                for k, place in enumerate(places):
                    first, last = ends[starts[k]], ends[starts[k + 1]]
                    digests[place] = hashlib.sha256(letters[first : max(first, last - 1)]).hexdigest()
                    decoded[place] = _sha256(encoder.decoded(part[k]))
                    if with_ids:
                        kept[place] = ids[starts[k] : starts[k + 1]]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(tokens),
                "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if with_ids:
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))
                columns["ids"] = pa.ListArray.from_arrays(_ends(tokens).astype(np.int32), flat)
            yield pa.record_batch(columns)

    digest = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(run, digest + ", ids array<int>" * with_ids)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
