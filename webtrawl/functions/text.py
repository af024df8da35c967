"""Tokens and phrases of cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{M}\p{N}_"

# Everything that is not part of a token.  Apostrophe and dot belong to a token
# only between two word characters.  Each alternative is a plain character run,
# so the pattern needs no stack however long the text is.
_SEPARATOR = rf"[^{WORD}'.]+|(?<![{WORD}])['.]+|['.]+(?![{WORD}])"


def tokens(text: Column) -> Column:
    """Lower-case tokens in text order."""
    return F.filter(F.split(F.lower(text), _SEPARATOR), lambda t: t != "")


def phrase(token_array: Column) -> Column:
    """One comparable string for a run of tokens; null where there are none."""
    return F.when(F.size(token_array) > 0, F.array_join(token_array, " "))
