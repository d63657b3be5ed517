"""Time helpers. ``as_of`` replaces the wall clock everywhere."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def as_time(value: str | datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(value))


def span(days: int = 0, hours: int = 0, minutes: int = 0, seconds: int | Column = 0) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), secs.cast("decimal(18,6)"))


def before(as_of: str | datetime | Column, **length: int) -> Column:
    return as_time(as_of) - span(**length)


def effective(published: str = "published_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(published), F.col(created))


def effective_from(start: Column, published: str = "published_at", created: str = "created_at") -> Column:
    """``effective() >= start`` in a form that reaches the statistics of stored files."""
    return (F.col(published) >= start) | (F.col(published).isNull() & (F.col(created) >= start))


def epoch_seconds(col: Column | str) -> Column:
    return F.unix_seconds(F.to_timestamp(col))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return epoch_seconds(end) - epoch_seconds(start)


def day_start(as_of: str | datetime | Column) -> Column:
    return F.date_trunc("day", as_time(as_of))
