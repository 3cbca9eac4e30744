"""Time windows over evidence: half-open, on parsed instants, with honest counts of what was considered and left out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_substantive


def _considered(items: DataFrame, platforms: Sequence[str]) -> DataFrame:
    wanted = [p.strip().lower() for p in platforms if p.strip()]
    return items.where(F.lower(F.trim("platform")).isin(wanted)) if wanted else items


def _checked(since: datetime, until: datetime) -> None:
    if until <= since:
        raise ValueError("until must be after since")


def select_window(items: DataFrame, since: datetime, until: datetime, platforms: Sequence[str] = ()) -> DataFrame:
    """Rows with since <= published_at < until, published_at being parsed once at ingest so that Parquet can skip."""
    _checked(since, until)
    return _considered(items, platforms).where((F.col("published_at") >= F.lit(since)) & (F.col("published_at") < F.lit(until)))


def window_counters(items: DataFrame, since: datetime, until: datetime, platforms: Sequence[str] = ()) -> DataFrame:
    """considered, selected, unparseable of items (published_at), in one pass."""
    _checked(since, until)
    inside = (F.col("published_at") >= F.lit(since)) & (F.col("published_at") < F.lit(until))
    return _considered(items, platforms).agg(F.count("*").alias("considered"), F.count_if(inside).alias("selected"), F.count_if(F.col("published_at").isNull()).alias("unparseable"))


def exclude_non_substantive(items: DataFrame) -> DataFrame:
    return items.where(is_substantive(F.col("text")))
