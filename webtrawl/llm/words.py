"""Words of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOW = 0x3000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


class Characters:
    """Whether code points have a property; the higher ones are looked up as they occur."""

    def __init__(self, has: Callable[[str], bool]):
        self.has = has
        self.low = np.array([has(chr(i)) for i in range(_LOW)])

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.low[np.minimum(points, _LOW - 1)]
        high = points >= _LOW
        if high.any():
            kinds, at = np.unique(points[high], return_inverse=True)
            found[high] = np.array([self.has(chr(c)) for c in kinds])[at]
        return found


def letter(c: str) -> bool:
    return c.isalpha()


def in_word(c: str) -> bool:
    """Letters, digits, marks and the underscore."""
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * _TURN
    values = values ^ (values >> np.uint64(29))
    values = values * _STEP
    return values ^ (values >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts_of(sizes: np.ndarray | list[int]) -> np.ndarray:
    """Where items of these sizes begin when laid end to end, and where the last ends."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


class WordHasher:
    """Hashes the words of texts in lower case."""

    def __init__(self):
        self.in_word = Characters(in_word)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes end to end, and where each text's begin (one place more).

        A word's hash is the sum of its characters' values times powers of an
        odd number, mixed.
        """
        # A blank after each text keeps words of neighbours apart.
        lowered = [t.lower() + " " for t in texts]
        points = code_points("".join(lowered))
        ends = starts_of([len(t) for t in lowered])
        inside = self.in_word(points)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = np.flatnonzero(begins)
        if not len(first):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        # Word characters only, and the place of each in its word.
        at = np.flatnonzero(inside)
        sizes = np.diff(np.append(np.searchsorted(at, first), len(at)))
        begin = starts_of(sizes)[:-1]
        place = np.arange(len(at)) - np.repeat(begin, sizes)
        longest = int(sizes.max())
        if len(self.powers) < longest:
            self.powers = np.cumprod(np.concatenate([[1], np.full(2 * longest, _STEP)]).astype(np.uint64))
        values = (points[at].astype(np.uint64) + np.uint64(1)) * _TURN
        values ^= values >> np.uint64(31)
        hashes = mixed(np.add.reduceat(values * self.powers[place], begin))
        return hashes, np.searchsorted(first, ends)


def blocks(texts: list[str], chars: int) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, one text at least."""
    found, start, size = [], 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            found.append((start, k))
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        found.append((start, len(texts)))
    return found


def slices_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of a text column, a row at least.

    Only a slice at a time then becomes Python objects.
    """
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < len(batch):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, end - start)
        start = end
