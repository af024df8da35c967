"""Awkward rows that every operator must take."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use for their own columns.
CLASHING = ("row", "mark", "maybe", "block", "found", "size", "taken", "key", "id", "copy", "part", "at", "line")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    common = ["the", "of", "and", "a", "in", "is", "der", "la"]
    made = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(60)]
    return " ".join(draw.choice(common) if draw.random() < 0.4 else draw.choice(made) for _ in range(words))


def awkward_rows() -> list[tuple]:
    base = prose(1, 80)
    long = " ".join(prose(k, 500) for k in range(40)) + "\n" + "x" * 5000
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, base.upper(), "en", "a"),
        (4, base.replace("the", "teh", 1), "en", None),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, "   \n\t ", "fr", "c"),
        (8, "...!! ?", "fr", "c"),
        (9, "one", "fr", ""),
        (10, "été où ça  déjà  vu\r\nNaïve ÉTÉ", "fr", "c"),
        (11, long, None, "a"),
        (12, long, "de", "b"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (13, prose(7, 30), "de", "b"),
        (13, prose(7, 30), "de", "b"),
        (13, prose(8, 30), "de", "b"),
        (14, "日本語 のテキスト 😀", None, "d"),
        (14, "日本語 のテキスト 😀", None, "d"),
    ]
    rows += [(20 + k, prose(100 + k, 60), ["en", "de", "fr"][k % 3], "abc"[k % 3]) for k in range(40)]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward documents, with columns that clash with the operators' own."""
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
