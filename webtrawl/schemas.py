"""Table definitions: Spark types plus the rules Spark types do not hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column and its rules; ``size`` is the longest text allowed, in characters."""

    name: str
    type: T.DataType
    required: bool = True
    default: int | str | None = None
    size: int | None = None
    key: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]

    @property
    def schema(self) -> T.StructType:
        """A key may be null on the way in: it is given out on insert."""
        return T.StructType([T.StructField(f.name, f.type, not f.required or f.key) for f in self.fields])

    @property
    def key(self) -> list[str]:
        return [f.name for f in self.fields if f.key]


def text(name: str, size: int, **rules) -> Field:
    return Field(name, T.StringType(), size=size, **rules)


def integer(name: str, **rules) -> Field:
    return Field(name, T.IntegerType(), **rules)


def instant(name: str, **rules) -> Field:
    return Field(name, T.TimestampNTZType(), **rules)


def compose(name: str, bases: Sequence[Table], *own: Field) -> Table:
    """A table with the fields of ``bases`` and its own; a base's field wins over an own one."""
    fields = {f.name: f for f in own}
    for base in bases:
        fields.update({f.name: f for f in base.fields})
    return Table(name, tuple(fields.values()))


# Passwords are not carried in any table.
USERS = Table(
    "Users",
    (
        integer("id", key=True),
        text("email", 32),
        text("name", 32),
        instant("created_date"),
        instant("last_login_date"),
    ),
)

TOKENS = Table("Token", (text("token", 36), integer("user_id"), instant("expire_date")))

CRAWLER_STATS = Table(
    "CrawlerStats",
    (
        text("domain", 255),
        text("status", 64),
        integer("author_id"),
        integer("https", required=False, default=0),
        instant("time"),
        integer("pages_count", required=False, default=0),
        Field("avg_time_per_page", T.DoubleType(), required=False),
        Field("max_time_per_page", T.DoubleType(), required=False),
        Field("min_time_per_page", T.DoubleType(), required=False),
        # When the crawl took place that the row tells of; a copy keeps it.
        Field("crawled_at", T.TimestampNTZType(), required=False),
    ),
)

DOCUMENTS = T.StructType(
    [T.StructField("url", T.StringType(), False), T.StructField("content", T.StringType(), False)]
)

# Message bodies.  A crawl task comes as {type, data: {domain, author_id}} or as
# {type, index: {domain, https}}; the other messages use data.
MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("domain", T.StringType()),
                    T.StructField("author_id", T.IntegerType()),
                    T.StructField("email", T.StringType()),
                    T.StructField("name", T.StringType()),
                    T.StructField("token", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "index",
            T.StructType(
                [
                    T.StructField("domain", T.StringType()),
                    T.StructField("https", T.BooleanType()),
                ]
            ),
        ),
    ]
)
