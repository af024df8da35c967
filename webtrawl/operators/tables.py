"""Row verbs on a table: filter, get, update, delete, upsert, validate, ids.

A write is a new DataFrame (a new snapshot to store); nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.operators.ordered import number_rows
from webtrawl.schemas import Table

# Reasons a row is refused.
REQUIRED = "field value is none but required"
TOO_LONG = "incorrrect str size"
NOT_A_NUMBER = "not a number"
NOT_OF_TYPE = "not of its type"


class DoesNotExist(LookupError):
    """No row matches."""


def equals_all(values: Mapping[str, object]) -> Column:
    """``column = value`` for each pair, all of them; a null never matches."""
    if not values:
        raise ValueError("at least one column is needed")
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()])


def filter_rows(table: DataFrame, **values) -> DataFrame:
    return table.where(equals_all(values))


def get_row(table: DataFrame, key: Sequence[str], **values):
    """The first match by key; the reads stop at one row."""
    row = table.where(equals_all(values)).orderBy(*key).limit(1).first()
    if row is None:
        raise DoesNotExist(f"{values} does not exist")
    return row


def get_rows(lookups: DataFrame, table: DataFrame, on: Sequence[str], key: str) -> DataFrame:
    """:func:`get_row` for a table of lookups; ``found`` tells the ones without a match.

    The table is cut to its first row for each lookup value before the join.
    """
    others = [c for c in table.columns if c not in on]
    first = table.groupBy(*on).agg(F.min_by(F.struct(*others), key).alias("_row"))
    return lookups.join(first, list(on), "left").select(
        *lookups.columns,
        *[F.col("_row")[c].alias(c) for c in others],
        F.col("_row").isNotNull().alias("found"),
    )


def update_rows(table: DataFrame, changes: Mapping[str, object], **values) -> DataFrame:
    """Set ``changes`` where every pair of ``values`` holds; other rows stay."""
    hit = equals_all(values)
    return table.select(
        *[
            F.when(hit, F.lit(changes[c]).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in changes
            else F.col(c)
            for c in table.columns
        ]
    )


def delete_rows(table: DataFrame, **values) -> DataFrame:
    """Drop rows where every pair holds; a null comparison keeps the row."""
    return table.where(~F.coalesce(equals_all(values), F.lit(False)))


def delete_by_key(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """``table`` with ``changes`` merged in by key; of several changes the newest wins.

    The changes are cut to one for each key before they meet the table, which
    then loses its replaced rows by an anti join: no sort of the whole table.
    """
    rows = F.struct(*[F.col(c) for c in table.columns])
    newest = (
        changes.groupBy(*key)
        .agg(F.max_by(rows, F.struct(*version)).alias("_row"))
        .select(*[F.col("_row")[c].alias(c) for c in table.columns])
    )
    return table.join(newest, list(key), "left_anti").unionByName(newest)


def apply_defaults(rows: DataFrame, table: Table, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of ``table``, cast to its types, nulls replaced by the column default."""

    def value(f) -> Column:
        # A value that is not of the column's type becomes null, as a missing one.
        typed = F.col(f.name).try_cast(f.type) if f.name in rows.columns else F.lit(None).cast(f.type)
        return typed if f.default is None else F.coalesce(typed, F.lit(f.default).cast(f.type))

    return rows.select(*[value(f).alias(f.name) for f in table.fields], *keep)


def not_of_type(rows: DataFrame, table: Table) -> Column:
    """``column: reason`` of the first value that cannot be read as its column's type, or null."""
    checks = [
        F.when(
            F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.type).isNull(),
            F.lit(f"{f.name}: {NOT_A_NUMBER if isinstance(f.type, T.NumericType) else NOT_OF_TYPE}"),
        )
        for f in table.fields
        if f.name in rows.columns
    ]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def violation(table: Table) -> Column:
    """Why a row breaks the rules, as ``column: reason`` of its first fault, or null."""
    checks = []
    for f in table.fields:
        if f.size is not None:
            checks.append(F.when(F.char_length(f.name) > f.size, F.lit(f"{f.name}: {TOO_LONG}")))
        if f.required and not f.key:
            checks.append(F.when(F.col(f.name).isNull(), F.lit(f"{f.name}: {REQUIRED}")))
    return F.coalesce(*checks)


def validate(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with defaults filled in and a ``violation`` column, null for good rows."""
    # Judged by the values as they came, before they are cast and filled in.
    raw = rows.withColumn("_bad", not_of_type(rows, table))
    typed = apply_defaults(raw, table, ["_bad"])
    return typed.withColumn("violation", F.coalesce("_bad", violation(table))).drop("_bad")


def assign_ids(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Give ``rows`` the ids that follow the greatest one in ``table``, without gaps."""
    last = table.agg(F.max(key)).first()[0] or 0
    return number_rows(rows, order, key, after=int(last))
