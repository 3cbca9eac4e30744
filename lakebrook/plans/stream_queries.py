"""Queries that run streams over the events, as a log that is delivered in parts, and return what their sinks hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.commits import StateTable
from ..operators.loops import Budget
from ..session import shared_folder
from ..streaming import budgets, sinks
from .entities import Registry, table

q = Registry()
DELAY_DAYS, LATE = 3, "purchase"
BUDGET = Budget(calls=80, cost=2500.0, minutes=60 * 24 * 20.0, share=0.75)


def _folder(spark) -> str:
    """A folder of one query's log, checkpoint and result, deleted when the application ends."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


PASSED = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY_DAYS} DAY FROM events)"


@q("stream_budget", f"WITH e AS (SELECT user_id AS run_id, event_id AS call_id, ts AS \"at\", row_number() OVER w - 1 AS calls_before, round(coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before, ts - min(ts) OVER (PARTITION BY user_id) AS t FROM events WHERE ts < {PASSED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, CASE WHEN calls_before >= {BUDGET.share * BUDGET.calls} THEN 'CALLS' WHEN spent_before >= {BUDGET.share * BUDGET.cost} THEN 'COST' WHEN t >= INTERVAL {int(BUDGET.share * BUDGET.minutes)} MINUTE THEN 'MINUTES' ELSE 'ADMITTED' END AS decision FROM e), f AS (SELECT run_id, min(calls_before) AS stop FROM r WHERE decision <> 'ADMITTED' GROUP BY run_id) SELECT r.run_id, call_id, \"at\", decision, calls_before, spent_before FROM r LEFT JOIN f ON f.run_id = r.run_id WHERE stop IS NULL OR calls_before <= stop")
def stream_budget(spark, d):
    """Users' events as calls of runs, with a budget for each run: what was admitted, and where and why each run stopped, of
    the calls that the watermark has passed. A stream with a state and timers for each run."""
    folder, events = _folder(spark), table(spark, d, "events")
    events.write.parquet(f"{folder}/log")
    budgets.provide(spark)
    log = spark.readStream.schema(events.schema).parquet(f"{folder}/log")
    calls = log.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"), F.col("value").alias("cost"))
    sinks.run_to_end(budgets.run_budgets(calls, BUDGET, f"{DELAY_DAYS} days"), f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.schema(budgets.DECISIONS).parquet(f"{folder}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


@q("stream_late_counts", f"WITH passed AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY_DAYS} DAY AS w FROM events WHERE event_type <> '{LATE}'), taken AS (SELECT * FROM events, passed WHERE event_type <> '{LATE}' OR ts > w) SELECT event_type, date_trunc('day', ts) AS start_at, count(*) AS n FROM taken WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {PASSED} GROUP BY 1, 2")
def stream_late_counts(spark, d):
    """Events by day and type, of closed days, from a log whose purchases come after all others, with the others delivered
    again: late ones are left out, repeated ones counted once. The stream is ended and started again between the two."""
    folder, events = _folder(spark), table(spark, d, "events")
    late = F.col("event_type") == LATE
    counts = StateTable(spark, f"{folder}/counts", ["event_type", "start_at"])
    for delivery in (events.where(~late), events):
        delivery.write.mode("append").parquet(f"{folder}/log")
        log = spark.readStream.schema(events.schema).parquet(f"{folder}/log")
        days = sinks.closed_windows(sinks.once(log, "ts", "event_id", f"{DELAY_DAYS} days"), "ts", ["event_type"], "1 day")
        sinks.run_to_end(days, f"{folder}/checkpoint", sinks.merged(counts))
    return counts.read().withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))
