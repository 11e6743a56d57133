"""Microsecond arithmetic on a UTC time grid.

Ticks, panes and windows are multiples of a step counted from the Unix epoch, so all
grid arithmetic is integer arithmetic on microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
ROUND_MICROS = {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}

_UTC = {"UTC", "ETC/UTC", "Z", "GMT", "+00:00", "UCT", "ZULU", "ETC/GMT"}


def require_utc(spark: SparkSession) -> None:
    """Grid arithmetic is wrong across daylight-saving changes, so insist on UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in _UTC:
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division rounding down; ``b`` must be positive."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def floor_to(a: Column, step: Column | int) -> Column:
    step = F.lit(step).cast("bigint") if isinstance(step, int) else step
    return a - F.pmod(a, step)


def add_micros(ts: Column, us: Column) -> Column:
    """``ts`` moved by ``us`` microseconds, kept as a naive timestamp."""
    return from_micros(micros(ts) + us)


def time_bounds(events: DataFrame, ts_col: str) -> tuple[Column, Column]:
    """First and last event time in microseconds, as scalar subqueries over one column."""
    ts = F.col(ts_col)
    return (
        events.select(micros(F.min(ts)).alias("first_us")).scalar(),
        events.select(micros(F.max(ts)).alias("last_us")).scalar(),
    )
