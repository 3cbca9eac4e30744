"""Streams that are stopped, killed and started again, against the same rules over all rows at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakebrook.operators.commits import StateTable
from lakebrook.operators.loops import Budget
from lakebrook.streaming import budgets, sinks

EVENTS = "event_id long, at timestamp, kind string"
CALLS = "run_id long, call_id long, at timestamp, cost double"
START = datetime(2026, 1, 1)


def deliver(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def admitted(rows, budget):
    """The rule, a call at a time."""
    out, runs = [], {}
    for run, call, at, cost in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[2], r[1])):
        state = runs.setdefault(run, {"calls": 0, "cost": 0.0, "began": at, "stopped": None})
        if state["stopped"]:
            continue
        if state["calls"] >= budget.share * budget.calls:
            state["stopped"] = "CALLS"
        elif round(state["cost"], 6) >= budget.share * budget.cost:
            state["stopped"] = "COST"
        elif at - state["began"] >= timedelta(minutes=budget.share * budget.minutes):
            state["stopped"] = "MINUTES"
        out.append((run, call, at, state["stopped"] or "ADMITTED", state["calls"], round(state["cost"], 6)))
        if not state["stopped"]:
            state["calls"] += 1
            state["cost"] += cost or 0.0
    return sorted(out)


def test_budgets_of_runs_over_several_deliveries_and_restarts(spark, tmp_path):
    """Calls arrive out of order and across restarts; one run has most of them; the last day isn't passed yet."""
    rng, budget, log = random.Random(3), Budget(25, 24.0, 3000.0, 0.8), str(tmp_path / "log")
    rows = []
    for i in range(500):
        run = 0 if rng.random() < 0.4 else rng.randint(1, 12)
        rows.append((run, i, START + timedelta(minutes=10 * i + rng.randint(-300, 300)), rng.choice([0.0, 1.0, 2.5, None])))
    rows += [(None, 900, START, 1.0), (3, None, START, 1.0), (4, 901, None, 1.0)]
    budgets.provide(spark)
    for first in range(0, 503, 101):
        deliver(spark, rows[first : first + 101], CALLS, log)
        stream = budgets.run_budgets(spark.readStream.schema(CALLS).parquet(log), budget, "1 day")
        sinks.run_to_end(stream, str(tmp_path / "checkpoint"), path=str(tmp_path / "out"))
    passed = max(r[2] for r in rows if r[2]) - timedelta(days=1)
    got = spark.read.schema(budgets.DECISIONS).parquet(str(tmp_path / "out")).collect()
    want = admitted([r for r in rows if r[2] and r[2] < passed], budget)
    assert sorted(map(tuple, got)) == want
    assert {w[3] for w in want} == {"ADMITTED", "CALLS", "COST", "MINUTES"}


def brute_days(deliveries, delay):
    """Counts of closed days, with what came too late or twice left out; and the watermark after each delivery."""
    watermark, seen, taken = datetime(1970, 1, 1), set(), []
    for rows in deliveries:
        for event, at, kind in rows:
            if at > watermark and event not in seen:
                seen.add(event)
                taken.append((at, kind))
        watermark = max([watermark, *[at - delay for _, at, _ in rows]])
    days = {}
    for at, kind in taken:
        day = datetime(at.year, at.month, at.day)
        if day + timedelta(days=1) <= watermark:
            days[kind, day] = days.get((kind, day), 0) + 1
    return days


@pytest.mark.parametrize("dies", ["never", "before the commit", "after the commit"])
def test_closed_days_over_late_repeated_and_killed_deliveries(spark, tmp_path, dies):
    """The sink fails in the third delivery's batch, before or after its version is put; the next start takes it again."""
    rng, log, delay = random.Random(7), str(tmp_path / "log"), timedelta(days=1)
    events = [(i, START + timedelta(hours=i), rng.choice("ab")) for i in range(200)]
    late = [(1000 + i, START + timedelta(hours=rng.randint(0, 199)), "a") for i in range(60)]
    deliveries = [events[:80], events[60:140] + late[:20], late[20:40] + events[100:200], late[40:] + events]
    table, fail = StateTable(spark, str(tmp_path / "days"), ["kind", "start_at"]), {"left": 0 if dies == "never" else 1}
    put, versions = sinks.merged(table), []

    def each(rows, number):
        if len(versions) == 2 and fail["left"] and rows.count():
            fail["left"] = 0
            if dies == "after the commit":
                put(rows, number)
            raise RuntimeError("killed")
        put(rows, number)

    for rows in deliveries:
        deliver(spark, rows, EVENTS, log)
        for _ in range(2):
            days = sinks.closed_windows(sinks.once(spark.readStream.schema(EVENTS).parquet(log), "at", "event_id", "1 day"), "at", ["kind"], "1 day")
            try:
                sinks.run_to_end(days, str(tmp_path / "checkpoint"), each)
                break
            except Exception as e:
                assert "killed" in str(e)
        versions.append(table.log.latest())
    assert fail["left"] == 0
    assert {(r.kind, r.start_at): r.n for r in table.read().collect()} == brute_days(deliveries, delay)


def test_a_batch_that_is_delivered_twice_changes_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["k"])
    each = sinks.merged(table)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "q1")
    try:
        rows = spark.createDataFrame([("a", 1)], "k string, n long")
        each(rows, 0)
        each(spark.createDataFrame([("a", 2)], "k string, n long"), 1)
        before = table.log.latest()
        each(rows, 0)
        assert table.log.latest() == before and [tuple(r) for r in table.read().collect()] == [("a", 2)]
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
