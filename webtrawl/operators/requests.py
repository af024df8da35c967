"""Checks on request parameters.  Each gives the status of the first fault, or ok."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.operators.accounts import FORBIDDEN, OK

# Statuses and the largest page of hits.
MAX_LIMIT = 100
LIMIT_RANGE = "limit shoud be between 1 and 100"
NOT_INTEGER = "invalid literal for int() with base 10: "
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
LARGEST = 2**63 - 1


def required(*names: str) -> Column:
    """``<name> required`` for the first missing parameter, else null."""
    return F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"{n} required")) for n in names])


def signup_status() -> Column:
    return F.coalesce(required("email", "password", "name"), F.lit(OK))


def login_status() -> Column:
    return F.coalesce(required("email", "password"), F.lit(OK))


def index_status() -> Column:
    """The domain is asked for before the token."""
    no_token = F.when(F.col("token").isNull(), FORBIDDEN)
    return F.coalesce(required("domain"), no_token, F.lit(OK))


def _number(name: str) -> Column:
    """The integer in a text, exact to 38 digits; null beyond that or if there is none."""
    digits = F.regexp_replace(F.col(name), r"\s", "")
    return F.when(F.col(name).rlike(_INTEGER), digits.try_cast("decimal(38,0)"))


def search_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``status`` and, where it is ok, integer ``size`` and ``start``.

    Needs q, limit and offset as texts.  A negative offset counts as 0.
    """

    def not_integer(name: str) -> Column:
        return F.when(
            ~F.col(name).rlike(_INTEGER), F.concat(F.lit(NOT_INTEGER + "'"), F.col(name), F.lit("'"))
        )

    in_range = F.coalesce(_number("limit").between(1, MAX_LIMIT), F.lit(False))
    status = F.coalesce(
        required("q", "limit", "offset"),
        not_integer("limit"),
        not_integer("offset"),
        F.when(~in_range, LIMIT_RANGE),
        F.lit(OK),
    )
    # An offset too long to hold is beyond every hit, unless it is negative.
    beyond = F.when(F.col("offset").contains("-"), 0).otherwise(LARGEST)
    start = F.least(F.greatest(F.coalesce(_number("offset"), beyond), F.lit(0)), F.lit(LARGEST))
    return requests.withColumn("status", status).withColumns(
        {
            "size": F.when(F.col("status") == OK, _number("limit").cast("int")),
            "start": F.when(F.col("status") == OK, start.cast("bigint")),
        }
    )


def split_by_status(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected requests."""
    return checked.where(F.col("status") == OK), checked.where(F.col("status") != OK)


def envelope(status: Column, data: Column) -> Column:
    """``{status, data}``: the data only where the status is ok."""
    return F.struct(
        F.coalesce(status, F.lit(OK)).alias("status"),
        F.when(F.coalesce(status, F.lit(OK)) == OK, data).alias("data"),
    )
