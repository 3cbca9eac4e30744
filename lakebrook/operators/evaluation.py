"""Evaluation analytics over attempts, tasks, labels and arms. Rates are ratios of sums; rounding comes last."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """Null where the denominator is 0."""
    return F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def usage_totals(attempts: DataFrame, *keys: str) -> DataFrame:
    """calls, output_tokens, latency, tokens a second (sum over sum), mean output tokens; by keys or overall."""
    tokens, latency = F.sum("output_tokens"), F.sum("latency_seconds")
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("calls"), tokens.alias("output_tokens"), F.round(latency, 3).alias("latency"),
        rate(tokens, latency, 3).alias("tokens_per_second"), rate(tokens, F.count("*"), 3).alias("mean_tokens"),
    )


def zero_filled(counts: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """Counts of rows for every value of the domain, 0 for those that don't occur. The domain is a literal list."""
    listed = counts.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return listed.join(counts.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def last_by(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    picked = F.max_by(F.struct(*columns), F.col(order))
    return rows.groupBy(key).agg(picked.alias("_l")).select(key, *[F.col("_l." + c).alias(c) for c in columns])


def role(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Of a case in two arms by the least and greatest of its repeats' matches."""
    noisy = (a_min != a_max) | (b_min != b_max)
    return F.when(noisy, "noise").when(a_min & b_min, "saturated_pass").when(~a_min & ~b_min, "saturated_fail").otherwise("discriminating")


def allocations(counts: Mapping[str, int], size: int, order: Sequence[str]) -> dict[str, int]:
    """A balanced sample size for every label present: all labels are filled to one level, as far as they have rows, and
    the first in order that have more get what is left over."""
    held = {label: counts[label] for label in order if counts.get(label)}
    filled = lambda level: sum(min(n, level) for n in held.values())
    if size < len(held) or size > filled(max(held.values(), default=0)):
        raise ValueError("the sample must cover every label and not exceed the rows")
    level = bisect_right(range(size + 1), size, key=filled) - 1
    above = [label for label, n in held.items() if n > level][: size - filled(level)]
    return {label: min(n, level) + (label in above) for label, n in held.items()}


def stratified_sample(rows: DataFrame, label: str, item: str, sizes: Mapping[str, int], seed: str) -> DataFrame:
    """The first rows of each label by sha256(seed:item): the same whatever the partitioning."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(item).cast("string")), 256), item)
    wanted = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in sizes.items()], F.lit(0))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= wanted).drop("_n")


def within_budget(units: DataFrame, key: str, order: str, cost: str, limit: float) -> DataFrame:
    """Units started while the spend before them was under the limit; the one that crosses the line is kept."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("spent_before", F.round(F.coalesce(F.sum(cost).over(before), F.lit(0.0)), 6)).where(F.col("spent_before") < limit)


def capped_merge(rows: DataFrame, group: str, item: str, priority: str, rank: str, cap: int) -> DataFrame:
    """Items of each group once, by priority then rank, at most cap; those of priority 0 are never dropped."""
    first = Window.partitionBy(group, item).orderBy(priority, rank)
    place = Window.partitionBy(group).orderBy(priority, rank, item)
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(place).cast("long")).where((F.col("place") <= cap) | (F.col(priority) == 0))


def take_while(rows: DataFrame, key: str, order: Sequence[Column], holds: Column) -> DataFrame:
    """Rows of each key before the first that doesn't hold."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_broken", F.max((~holds).cast("int")).over(w)).where("_broken = 0").drop("_broken")


def quality_gate(checks: DataFrame, task: str, name: str, passed: str, critical: str, least: float) -> DataFrame:
    """pass_fraction, failed, critical_failures and accepted of each task's checks (name, passed, critical)."""
    failed = F.sort_array(F.collect_list(F.when(~F.col(passed), F.col(name))))
    worst = F.sort_array(F.collect_list(F.when(~F.col(passed) & F.col(critical), F.col(name))))
    got = checks.groupBy(task).agg(F.avg(F.col(passed).cast("double")).alias("f"), failed.alias("failed"), worst.alias("critical"))
    reason = F.when(F.size("critical") > 0, "CRITICAL_FAILURE").when(F.col("f") < least, "BELOW_THRESHOLD").otherwise("PASSED")
    return got.select(task, F.round("f", 6).alias("pass_fraction"), F.array_join("failed", ",").alias("failed"), F.array_join("critical", ",").alias("critical_failures"), reason.alias("reason"))
