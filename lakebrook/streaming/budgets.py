"""Budgets of many runs at once, kept over the stream of their calls: a small state machine for each run.

A run's calls are admitted in the order of their times, whatever the order they arrive in: they wait in a list until the
watermark has passed them, a timer being set to the earliest. The state holds how many were admitted, what they cost, when
the run began and why it stopped. Before each call the limits are looked at, calls first, then cost, then time; at the first
one that is reached the run stops for good, and later calls are only forgotten. Calls behind the watermark come too late
and are dropped by Spark. What waits is bounded by the watermark's delay, and the rest of a run's state is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.loops import Budget

#: The only state store that keeps several states and timers for a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "run_id long, call_id long, at timestamp, decision string, calls_before long, spent_before double"
ADMITTED = "ADMITTED"


def provide(spark: SparkSession) -> None:
    """Sets the state store that run_budgets needs, before its query starts."""
    from pyspark.errors import PySparkException

    for provider in (PROVIDER, PROVIDER.replace(".streaming.state.", ".streaming.runtime.state.")):
        try:
            spark._jvm.java.lang.Class.forName(provider)
        except (PySparkException, Exception):
            continue
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
        return
    raise RuntimeError("this Spark has no RocksDB state store")


class RunBudget(StatefulProcessor):
    def __init__(self, budget: Budget):
        self.calls, self.cost = budget.share * budget.calls, budget.share * budget.cost
        self.micros = int(60_000_000 * budget.share * budget.minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "calls long, cost double, began long, stopped string")
        self.waiting = handle.getListState("waiting", "at long, call_id long, cost double")

    def _wait(self, rows: list[tuple[int, int, float]]) -> None:
        if rows:
            self.waiting.put(rows)
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stopped = self.run.exists() and self.run.get()[3]
        new = [] if stopped else [row for part in rows for row in zip(part["micros"].astype(int).tolist(), part["call_id"].astype(int).tolist(), part["cost"].astype(float).tolist())]
        if new:
            self._wait([tuple(r) for r in self.waiting.get()] + new if self.waiting.exists() else new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        calls, cost, began, stopped = self.run.get() if self.run.exists() else (0, 0.0, None, None)
        out = []
        for at, call_id, price in rows:
            if at >= passed or stopped:
                break
            began = at if began is None else began
            spent = round(cost, 6)
            stopped = "CALLS" if calls >= self.calls else "COST" if spent >= self.cost else "MINUTES" if at - began >= self.micros else None
            out.append((key[0], call_id, at, stopped or ADMITTED, calls, spent))
            if not stopped:
                calls, cost = calls + 1, cost + price
        self.run.update((calls, cost, began, stopped))
        self._wait([] if stopped else [r for r in rows if r[0] >= passed])
        if out:
            frame = pd.DataFrame(out, columns=["run_id", "call_id", "at", "decision", "calls_before", "spent_before"])
            yield frame.assign(at=pd.to_datetime(frame["at"], unit="us"))

    def close(self) -> None:
        pass


def run_budgets(calls: DataFrame, budget: Budget, delay: str) -> DataFrame:
    """Decisions on a stream of calls (run_id, call_id, at, cost): each admitted call, and of each run that stops the call at
    which it did, with the limit that was reached."""
    timed = calls.select("run_id", "call_id", F.col("at").cast("timestamp").alias("at"), F.coalesce("cost", F.lit(0.0)).alias("cost")).where("run_id is not null and call_id is not null and at is not null")
    timed = timed.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunBudget(budget), outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime")
