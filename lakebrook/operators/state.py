"""State tables without a store: idempotent upserts, monotone cursors, alias merges and two-way consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses after which an item isn't tried again.
TERMINAL = ("COMPLETED", "SKIPPED_SHORT_NO_SPEECH")


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def status_category(status: Column) -> Column:
    failed = status.startswith("FAILED") | (status == "COMPLETED_WITH_FAILURES")
    warned = status.startswith("SKIPPED_") | (status == "COMPLETED_WITH_WARNINGS")
    return F.when(failed, "FAILURE").when(warned, "WARNING").otherwise("INFO")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last by order (most significant first)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new put over those of the same key. Of several rows of new with one key the last by order wins,
    and of those equal in it the one with the greatest hash, so that the result is the same whenever it is computed."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, keys, [F.col("_v"), *map(F.col, order), F.xxhash64(*old.columns)]).drop("_v")


def identity_conflicts(old: DataFrame, new: DataFrame, keys: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Keys in both whose fixed columns differ; such an upsert must be refused."""
    a, b = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in fixed]), new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fixed])
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return a.join(b, list(keys)).where(differs)


def terminal_cursor(content: DataFrame, keys: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """The latest published_at among terminal rows of each key, others being ignored. With the stored cursors (keys,
    cursor) it never moves back: the later of the two holds, and a key that only one side has keeps its own."""
    seen = content.groupBy(*keys).agg(F.max(F.when(is_terminal(F.col("status")), F.col("published_at"))).alias("cursor"))
    if stored is None:
        return seen
    return seen.unionByName(stored.select(*keys, "cursor")).groupBy(*keys).agg(F.max("cursor").alias("cursor"))


def after_cursor(items: DataFrame, cursors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items later than their source's cursor, which itself is excluded; all where there is none."""
    return items.join(cursors, list(keys), "left").where("cursor is null or published_at > cursor").drop("cursor")


def merge_alias(rows: DataFrame, key: str, alias, canonical, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows under one key, content ids that both had): a merge with such an overlap must be refused."""
    overlap = rows.where(F.col(key) == alias).select(content).intersect(rows.where(F.col(key) == canonical).select(content))
    return rows.withColumn(key, F.when(F.col(key) == alias, F.lit(canonical)).otherwise(F.col(key))), overlap


def consistency(local: DataFrame, central: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, finding: match, missing_central or mismatch for each local row."""
    c = central.select(*keys, F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    finding = F.when(F.col("_there").isNull(), "missing_central").when(same, "match").otherwise("mismatch")
    return local.join(c, list(keys), "left").select(*keys, finding.alias("finding"))


def missing_local(local: DataFrame, central: DataFrame, keys: Sequence[str], source: Sequence[str]) -> DataFrame:
    """Central rows that a source's local state lacks; sources without any local state aren't reported."""
    return central.join(local.select(*source).distinct(), list(source), "left_semi").join(local.select(*keys), list(keys), "left_anti")
