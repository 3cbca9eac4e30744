"""Instants: lenient and strict parsing, clamped windows, window lengths. The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole date, with or without a time and an offset. Spark alone would also take "2026" or "12:30".
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
ZONED = r"(Z|z|[+-]\d{2}:?\d{2})$"
BASIC = r"^\d{8}$"


def normalize_ts(value: Column) -> Column:
    """Blank or junk is null; without an offset it is UTC."""
    v = F.trim(value)
    return F.when(v.rlike(BASIC), F.try_to_timestamp(v, F.lit("yyyyMMdd"))).when(v.rlike(ISO), F.try_to_timestamp(v))


def strict_ts(value: Column) -> Column:
    """As normalize_ts, but null without an offset too; raise on nulls where the field is required."""
    v = F.trim(value)
    return F.when(v.rlike(ZONED), normalize_ts(v))


def until_end_of_day(day: Column) -> Column:
    return (day.cast("date") + F.expr("interval 1 day")).cast("timestamp") - F.expr("interval 1 microsecond")


def clamp_since(since: Column, until: Column, days: int) -> Column:
    return F.greatest(since, until - F.expr(f"interval {days} days"))


def window_days(since: Column, until: Column, digits: int = 3) -> Column:
    micros = F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.round(F.greatest(micros / F.lit(86_400_000_000.0), F.lit(1.0)), digits)
