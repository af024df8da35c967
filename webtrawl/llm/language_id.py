"""Language identification as inference of a mixture.

Each language has a distribution over hashed character trigrams, counted over all
labelled documents.  A text's trigrams are taken as drawn from a mixture of
languages; expectation-maximisation finds the proportions, and a language enters
the set only while it raises the likelihood by more than a penalty.  A text's
language is the one with the largest proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import empty_if_null, quoted
from webtrawl.llm.words import Characters, code_points, letter

UNDETERMINED = "und"

# Trigrams are hashed to so many cells; a language takes 512 KiB of the model.
CELLS = 1 << 16

# The model goes to every task, so its size is bounded by the number of labels.
MAX_LANGUAGES = 1_000

# Added to each cell's count.
SMOOTHING = 0.05

# A language must raise the log likelihood by this many nats for each halving of
# its weight in the text.  Trigrams overlap, so three count as one observation.
PENALTY = 2.0
OVERLAP = 3.0

# A text is strange when its trigrams are less likely than even ones to this power.
STRANGE = 1.2

STEPS = 40
SETTLED = 1e-4


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def cells_of(text: str, letters: Characters) -> np.ndarray:
    """The cell of each trigram of a text: letters in lower case, the rest as one blank.

    A text without a letter has none.
    """
    points = code_points(text.lower())
    points = np.where(letters(points), points, 32)
    padded = np.concatenate([[32], points, [32]]).astype(np.uint32)
    blank = padded == 32
    padded = padded[~(blank & np.append(False, blank[:-1]))]
    if len(padded) < 3:
        return np.zeros(0, np.int64)
    first, second, third = padded[:-2], padded[1:-1], padded[2:]
    mixed = first * np.uint32(0x9E3779B1) ^ second * np.uint32(0x85EBCA6B) ^ third * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Probabilities of the cells by language, and the languages in code point order."""

    languages: list[str]
    cells: np.ndarray  # languages × CELLS


def count_cells(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, cell, n) over all rows with a language; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Characters(letter)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(*(batch.column(c).to_pylist() for c in ("text", "lang")), strict=True):
                own = counts.setdefault(l, np.zeros(CELLS, np.int64))
                np.add.at(own, cells_of(t, letters), 1)
        for l, own in counts.items():
            seen = np.flatnonzero(own)
            yield pa.record_batch(
                {
                    "lang": pa.array([l] * len(seen), pa.string()),
                    "cell": pa.array(seen, pa.int32()),
                    "n": pa.array(own[seen], pa.int64()),
                }
            )

    slim = docs.select(empty_if_null(quoted(text)).alias("text"), quoted(lang).alias("lang"))
    parts = slim.where("lang is not null").mapInArrow(run, "lang string, cell int, n bigint")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of every labelled row.  It has CELLS numbers for each label, whatever the rows."""
    counts = count_cells(docs, text, lang)
    labelled = docs.select(quoted(lang).alias("lang")).where("lang is not null").distinct()
    languages = sorted(r.lang for r in labelled.limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels, which are not languages")
    place = {l: k for k, l in enumerate(languages)}
    cells = np.full((len(languages), CELLS), SMOOTHING)
    rows = counts.groupBy("lang").agg(
        F.array_agg("cell").alias("cells"), F.array_agg("n").alias("n")
    )
    for r in rows.toLocalIterator():  # at most MAX_LANGUAGES rows of CELLS entries
        cells[place[r.lang], r.cells] += r.n
    return Model(languages, cells / cells.sum(axis=1, keepdims=True))


def proportions(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the weights of the rows of ``cells`` (sources × kinds); weights and log likelihood."""
    weights = np.full(len(cells), 1 / len(cells))
    total = counts.sum()
    for _ in range(STEPS):
        new = weights * (cells @ (counts / (weights @ cells))) / total
        moved = np.abs(new - weights).max()
        weights = new
        if moved < SETTLED:
            break
    return weights, float(counts @ np.log(weights @ cells))


@dataclass
class Found:
    """The languages of one text with their proportions, largest first."""

    languages: list[str]
    weights: list[float]
    score: float
    known: bool  # whether there are letters, and the mixture does not find them strange


def infer(model: Model, cells: np.ndarray) -> Found:
    """The set of languages by forward selection under the penalty.

    The score is the proportion of the first language times its posterior
    against every other single one, tempered by the root of the text's length.
    """
    if not len(cells) or not model.languages:
        return Found([], [], 0.0, len(cells) > 0)
    kinds, counts = np.unique(cells, return_counts=True)
    likely = model.cells[:, kinds]
    total = counts.sum()
    alone = np.log(likely) @ counts
    chosen = [int(alone.argmax())]
    weights, best = np.ones(1), float(alone.max())
    floor = PENALTY * OVERLAP * math.log2(total + 1)
    while len(chosen) < len(model.languages):
        # The likelihood is concave in the weights: a language whose slope at
        # weight zero does not exceed 1 cannot raise it.
        slopes = likely @ (counts / (weights @ likely[chosen])) / total
        slopes[chosen] = 0
        added = int(slopes.argmax())
        # Its gain is at most log(slope) for each observation.
        if slopes[added] <= 1 or total * math.log(slopes[added]) < floor:
            break
        tried, reached = proportions(likely[[*chosen, added]], counts)
        if reached - best < floor:
            break
        chosen, weights, best = [*chosen, added], tried, reached
    order = np.lexsort((chosen, -weights))
    first = chosen[order[0]]
    tempered = (alone - alone[first]) / math.sqrt(total)
    posterior = 1 / np.exp(np.minimum(tempered, 50)).sum()
    return Found(
        [model.languages[chosen[k]] for k in order],
        [float(weights[k]) for k in order],
        float(min(1.0, max(0.0, weights[order[0]] * posterior))),
        best > -STRANGE * total * math.log(CELLS),
    )


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those that no learned language explains: null, without a letter, or strange.

    Learns from every labelled row of ``docs``; without any, a letter is enough.
    """
    slim = docs.select(F.struct("*").alias("row"), quoted(text).alias("text"))
    found = predict(slim, learn(docs, text, lang))
    return found.where("found.known").select("row.*")


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a struct (lang, score, known, languages, weights) for each whole text.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text where nothing has been learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, learned = Characters(letter), sent.value
        for batch in batches:
            found = [infer(learned, cells_of(t or "", letters)) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f.languages[0] if f.languages else UNDETERMINED for f in found], pa.string()),
                    pa.array([f.score for f in found], pa.float64()),
                    pa.array([f.known for f in found], pa.bool_()),
                    pa.array([f.languages for f in found], pa.list_(pa.string())),
                    pa.array([f.weights for f in found], pa.list_(pa.float64())),
                ],
                ["lang", "score", "known", "languages", "weights"],
            )

    function = F.arrow_udf(
        run,
        "lang string, score double, known boolean, languages array<string>, weights array<double>",
    )
    return docs.withColumn(name, function(quoted(text)))
