"""Instants on ``timestamp_ntz``, all free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def seconds(n: Column | int | float) -> Column:
    """A day-time interval of ``n`` seconds."""
    zero = F.lit(0)
    value = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(zero, zero, zero, value.cast("decimal(18,6)"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.call_function("div", ts - epoch(), F.expr("INTERVAL '0.000001' SECOND"))


def floor_div(n: Column, by: int) -> Column:
    """``n`` over ``by`` rounded down, in whole numbers throughout."""
    divisor = F.lit(by).cast("bigint")
    return F.call_function("div", n - F.pmod(n, divisor), divisor)


def from_micros(n: Column) -> Column:
    """Inverse of :func:`micros`."""
    days = floor_div(n, 86_400 * MICROS)
    rest = (n - days * (86_400 * MICROS)).cast("decimal(18,0)") / MICROS
    zero = F.lit(0)
    return epoch() + F.make_dt_interval(days.cast("int"), zero, zero, rest.cast("decimal(18,6)"))


def time_text(ts: Column) -> Column:
    """``2024-01-31 09:05:00``: second precision, cut not rounded."""
    return F.substring(ts.cast("string"), 1, 19)


def to_second(ts: Column) -> Column:
    return time_text(ts).cast("timestamp_ntz")


def expiry(issued: Column) -> Column:
    """A token expires one day after its issue, at second precision."""
    return to_second(issued) + F.make_dt_interval(F.lit(1))


def is_expired(expire: Column, now: Column) -> Column:
    """Strictly before ``now``: a token is still good at its expiry instant."""
    return expire < to_second(now)
