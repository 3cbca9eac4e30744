"""Controllers around an injected client: a research query, an agent task, a digest of a frozen window, a library update.

A research query and a task are one question each and live on the driver. A digest judges as many items as its window has:
its items stay in DataFrames, a batch of calls runs on the executors, and the budget is looked at between batches.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass
from itertools import accumulate
from types import MappingProxyType
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_json_object
from ..functions.validation import ASSESSMENT, LABELS, assessment_error
from ..sources.documents import load_snapshot, write_document
from .index import fingerprint, match_counts, top_items
from .loops import Budget, Checkpoints, Progress, Rejected, cache_key
from .runs import new_run
from .store import IndexStore


def research(question: str, index: IndexStore, store: Checkpoints, limit: int = 8, force: bool = False) -> dict[str, Any]:
    """The items that answer a question and how many there are; SUPPORTED means that something was found, no more.

    The result is kept under question, limit and the fingerprint of the index, and is given again while these hold.
    """
    question = question.strip()
    if not question or limit < 1:
        raise ValueError("a question and a positive limit are needed")
    signature = fingerprint(index.table("items")).first()["fingerprint"]
    key = cache_key(loop="RESEARCH_QUERY", question=question, limit=limit, index=signature)
    kept = None if force else store.load(key)
    if kept and kept.outcome == "COMPLETED":
        return kept.done["result"]
    scored = index.search(index.spark.createDataFrame([(0, question)], "query_id long, query string"))
    best = top_items(scored, limit).join(index.table("chunks"), ["evidence_id", "chunk_index"]).orderBy("rank")
    evidence = [r.asDict() for r in best.select("evidence_id", "chunk_index", "rank", "score", F.col("text").alias("snippet")).collect()]
    counts = match_counts(scored, limit).drop("query_id").first()
    result = {
        **new_run("RESEARCH_QUERY"), "question": question, "classification": "SUPPORTED" if evidence else "INSUFFICIENT_EVIDENCE",
        "retrieval": {"limit": limit, "index_signature": signature, **(counts.asDict() if counts else {"matched_chunks": 0, "matched_items": 0, "returned": 0, "truncated": False, "truncated_items": False})},
        "evidence": evidence, "answer": None,
    }
    store.save(Progress(key, "COMPLETED", {"result": result}))
    return result


@dataclass(frozen=True)
class Task:
    task_id: str
    question: str
    budget: Budget
    rounds: int = 3
    least_passed: float = 0.8

    def __post_init__(self) -> None:
        if not self.question.strip() or self.rounds < 1 or not 0 < self.least_passed <= 1:
            raise ValueError("a task needs a question, a round and a share within (0, 1]")


class ProviderError(Exception):
    """The provider failed. Unless it may be asked again, the task ends."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


CLASSES = {"SUPPORTED": None, "INSUFFICIENT_EVIDENCE": "INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE": "CONFLICTING_EVIDENCE"}


def gates(answer: dict[str, Any], supplied: set[str]) -> dict[str, tuple[bool, bool]]:
    """(holds, critical) of each criterion that an answer is judged by. Their names are fixed values."""
    cited, said = answer.get("citation_ids") or [], answer.get("classification")
    written = bool(str(answer.get("answer") or "").strip())
    return {
        "answer_nonempty": (written, True),
        "citations_present": (bool(cited), True),
        "citation_validation": (set(cited) <= supplied and len(set(cited)) == len(cited), True),
        "classification_valid": (said in CLASSES, True),
        "conflict_citation_coverage": (said != "CONFLICTING_EVIDENCE" or len(set(cited)) > 1, True),
        "citation_coverage": (len(set(cited)) >= min(2, len(supplied)), False),
        "output_schema": (written and bool(said), False),
    }


def agent_task(
    task: Task, evidence: list[dict[str, Any]], ask: Callable[[str, list[dict], str], tuple[dict, float]], store: Checkpoints,
    model: str, clock: Callable[[], float] = time.time, guidance: Mapping[str, str] = MappingProxyType({}),
) -> dict[str, Any]:
    """Asks, judges by the gates, asks again with what failed, up to the task's rounds and budget; else hands over to a person.

    ask(question, evidence, feedback) gives (answer, cost) or raises Rejected or ProviderError. A round in progress is
    resumed with its spending and its first start: a deadline is one of the task, not of a process. Answers that passed
    are given again; escalated ones are tried anew. guidance tells a person what to do, by the reason of a stop.
    """
    supplied = {str(e["evidence_id"]) for e in evidence}
    key = cache_key(task=asdict(task), evidence=sorted(supplied), model=model)
    state = store.load(key)
    if state and state.outcome in ("COMPLETED", "COMPLETED_AFTER_RETRY", "INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE"):
        return state.done["result"] | {"cache_hit": True}
    if state is None or state.outcome != "RUNNING":
        state = Progress(key, done={"attempts": [], "run": new_run("AGENT_TASK"), "began": clock(), "blocked": False})
    attempts, limit = state.done["attempts"], task.budget
    failed = attempts[-1]["failed"] if attempts else []
    outcome, reason = "ESCALATED_FOR_REVIEW", "QUALITY_GATE_NOT_REACHED"
    while len(attempts) < task.rounds and not state.done["blocked"]:
        store.save(state)
        if state.calls >= limit.share * limit.calls or state.cost >= limit.share * limit.cost or clock() - state.done["began"] >= 60 * limit.share * limit.minutes:
            outcome, reason = "FAILED_BUDGET", "BUDGET_EXHAUSTED"
            break
        state.calls += 1
        attempt: dict[str, Any] = {"round": len(attempts) + 1, "answer": None, "error": None, "failed": [], "cost_usd": 0.0}
        try:
            attempt["answer"], attempt["cost_usd"] = ask(task.question, evidence, ", ".join(failed))
            judged = gates(attempt["answer"], supplied)
            attempt["failed"] = failed = [name for name, (holds, _) in judged.items() if not holds]
            passed = all(holds for holds, critical in judged.values() if critical) and 1 - len(failed) / len(judged) >= task.least_passed
        except (Rejected, ProviderError) as e:
            passed, attempt["error"], failed = False, f"{type(e).__name__}: {e}", [str(e)]
            attempt["failed"] = failed
            state.done["blocked"] = isinstance(e, ProviderError) and not e.retryable
        attempts.append(attempt)
        state.cost = round(state.cost + attempt["cost_usd"], 8)
        if passed:
            outcome = CLASSES[attempt["answer"]["classification"]] or ("COMPLETED" if len(attempts) == 1 else "COMPLETED_AFTER_RETRY")
            reason = "QUALITY_GATE_PASSED"
            break
    if state.done["blocked"]:
        reason = "PROVIDER_REQUEST_FAILED"
    result = {
        **state.done["run"], "task_id": task.task_id, "question": task.question, "outcome": outcome, "stop_reason": reason, "cache_hit": False,
        "attempts": attempts, "model_calls": state.calls, "cost_usd": state.cost,
    }
    if outcome in ("ESCALATED_FOR_REVIEW", "FAILED_BUDGET"):
        result["human_review"] = handover(attempts, reason, guidance)
    state.outcome, state.done["result"] = outcome, result
    store.save(state)
    return result


def handover(attempts: list[dict[str, Any]], stop: str, guidance: Mapping[str, str]) -> dict[str, Any]:
    """What a person needs to take a task over, from its attempts: why it stopped and what the caller's guidance says about
    such a stop (nothing, where it is silent); how often each gate failed; the rounds that gave an answer, and the spending
    up to each round. Answers and errors themselves stay in the attempts."""
    spent = list(accumulate(a["cost_usd"] for a in attempts))
    return {
        "stop": stop, "guidance": guidance.get(stop),
        "failures": dict(Counter(name for a in attempts for name in a["failed"])),
        "answered_rounds": [a["round"] for a in attempts if a["answer"]],
        "spent_by_round": [round(s, 8) for s in spent],
    }


REPLY = "raw string, provider_error string, input_tokens long, output_tokens long, cost_usd double, latency_seconds double"
ATTEMPT = f"evidence_id string, attempt int, {REPLY}, error string"


def _asked(rows: DataFrame, assess: Callable[[dict[str, Any]], dict[str, Any]]) -> DataFrame:
    """rows with the reply to each, by calls on the executors. assess(row) gives the fields of REPLY."""
    names = [part.split()[0] for part in REPLY.split(", ")]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for row in batch.to_dict("records"):
                try:
                    reply = assess(row)
                except Exception as e:  # a failed call is a result: it was paid for and counts as an attempt
                    reply = {"provider_error": f"{type(e).__name__}: {e}"}
                replies.append([reply.get(n) for n in names])
            told = pd.DataFrame(replies, columns=names, index=batch.index)
            yield batch.assign(**{n: told[n] for n in names})

    return rows.mapInPandas(call, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {REPLY}")


def ranked(assessments: DataFrame) -> DataFrame:
    """place, from 1 within each label: most significant label first, then what was published first, then the id."""
    order = F.coalesce(*[F.when(F.col("label") == name, i) for i, name in enumerate(LABELS)], F.lit(len(LABELS)))
    w = Window.partitionBy("label").orderBy(F.coalesce(F.col("published_at").cast("string"), F.lit("")), "evidence_id")
    return assessments.withColumn("priority", order).withColumn("place", F.row_number().over(w).cast("long"))


def rejection(item: Column, error: Column, attempts: Column) -> Column:
    """struct(item_id, error_type, error, attempts) of an item that was given up."""
    kind = F.when(error.startswith("PROVIDER: "), F.regexp_extract(error, r"^PROVIDER: (\w+)", 1)).otherwise("ValidationError")
    return F.struct(item.alias("item_id"), kind.alias("error_type"), error.alias("error"), attempts.alias("attempts"))


def digest(
    snapshot_path: str, out: str, spark, assess: Callable[[dict[str, Any]], dict[str, Any]], budget: Budget, model: str,
    retries: int = 1, batch: int = 64, clock: Callable[[], float] = time.monotonic,
) -> dict[str, Any]:
    """Assesses every item (evidence_id, content_hash, source_key, published_at, text) of a frozen window and ranks what
    was accepted; ranks and rejections are tables beside the report.

    Each batch's attempts are appended to a table before the next begins, so that a run that stops is resumed: accepted
    items are never asked for again, those without an answer are, and so are rejected ones of an earlier run, each with
    the last error as feedback. Calls and cost add up over runs, the time is one run's own. A task that is lost with its
    executor asks again: its calls may be paid twice, but its rows come once. A finished digest calls nobody and reports anew.
    """
    snapshot, items = load_snapshot(spark, snapshot_path)
    if not snapshot["n_items"]:
        raise ValueError("the window holds no items")
    key = cache_key(loop="DIGEST", snapshot={k: snapshot[k] for k in ("since", "until", "platforms", "index_signature")}, model=model)
    log = f"{out}/{key}/attempts"
    spark.createDataFrame([], ATTEMPT).write.mode("append").parquet(log)
    items = items.withColumn("evidence_id", F.col("evidence_id").cast("string"))
    newest = F.max_by(F.struct("error", "raw"), "attempt").alias("last")
    began, first, stop = clock(), spark.read.parquet(log).agg(F.coalesce(F.max("attempt"), F.lit(0)).alias("n")).first()["n"], "COMPLETE"
    while True:
        seen = spark.read.parquet(log).groupBy("evidence_id").agg(F.max("attempt").alias("attempt"), F.count("*").alias("tries"), F.count_if(F.col("attempt") > first).alias("now"), newest)
        spent = spark.read.parquet(log).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost")).first()
        open_items = items.join(seen, "evidence_id", "left").where(F.col("last.error").isNotNull() | F.col("tries").isNull()).where(F.coalesce("now", F.lit(0)) <= retries)
        left = int(-(-budget.share * budget.calls // 1)) - spent["calls"]
        batch_rows = open_items.orderBy(F.coalesce("now", F.lit(0)), "evidence_id").limit(max(min(batch, left), 1))
        if batch_rows.isEmpty():
            break
        if left <= 0 or spent["cost"] >= budget.share * budget.cost or clock() - began >= 60 * budget.share * budget.minutes:
            stop = "BUDGET_REACHED"
            break
        # Attempts of this run are numbered on from the last of all, so that a resumed item gets its retries anew.
        number = (F.coalesce("now", F.lit(0)) + 1 + first).cast("int")
        replies = _asked(batch_rows.select("evidence_id", number.alias("attempt"), "text", F.col("last.error").alias("feedback")).repartition(spark.sparkContext.defaultParallelism), assess)
        error = F.when(F.col("provider_error").isNotNull(), F.concat(F.lit("PROVIDER: "), "provider_error")).otherwise(assessment_error(extract_json_object(F.col("raw")), F.col("text")))
        replies.withColumn("error", error).select(*[p.split()[0] for p in ATTEMPT.split(", ")]).write.mode("append").parquet(log)
    answers = items.drop("text").join(spark.read.parquet(log).groupBy("evidence_id").agg(newest, F.count("*").alias("tries")), "evidence_id", "left")
    parsed = F.from_json(extract_json_object(F.col("last.raw")), ASSESSMENT)
    accepted = answers.where("tries is not null and last.error is null").withColumn("a", parsed).withColumn("label", F.upper(F.trim("a.significance")))
    ranked(accepted.drop("last")).write.mode("overwrite").parquet(f"{out}/{key}/ranked")
    refused = answers.where("last.error is not null").select(rejection(F.col("evidence_id"), F.col("last.error"), F.col("tries")).alias("r")).select("r.*")
    refused.write.mode("overwrite").parquet(f"{out}/{key}/rejected")
    labels = {r["label"]: r["count"] for r in spark.read.parquet(f"{out}/{key}/ranked").groupBy("label").count().collect()}
    n_accepted, n_refused = sum(labels.values()), spark.read.parquet(f"{out}/{key}/rejected").count()
    usage = spark.read.parquet(log).agg(
        F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd", "latency_seconds")],
        F.round(F.sum("output_tokens") / F.when(F.sum("latency_seconds") > 0, F.sum("latency_seconds")), 2).alias("output_tokens_per_second"),
    ).first()
    outcome = "FAILED_BUDGET" if stop == "BUDGET_REACHED" else "COMPLETED" if n_accepted == snapshot["n_items"] else "ESCALATED_FOR_REVIEW"
    report = {
        **new_run("DIGEST"), "key": key, "outcome": outcome, "stop_reason": stop, "window": snapshot, "model": model, "items_total": snapshot["n_items"],
        "items_assessed": n_accepted, "items_rejected": n_refused, "label_counts": {name: labels.get(name, 0) for name in LABELS}, "usage_totals": usage.asDict(),
    }
    write_document(spark, f"{out}/{key}/report.json", report)
    return report


def library_update(ingest: Callable[[], int], collect: Callable[[], tuple[DataFrame, DataFrame]], index: IndexStore, path: str) -> dict[str, Any]:
    """Ingests, then indexes whatever is there, even where ingestion failed, and writes what happened.

    ingest() gives an exit code; collect() gives items (evidence_id, text) and warnings. At most 100 warnings are listed,
    all are counted.
    """
    try:
        code, error = ingest(), None
    except OSError as e:
        code, error = 127, str(e)
    items, warnings = collect()
    summary = index.refresh(items)
    report = {
        **new_run("LIBRARY_UPDATE"), "status": "COMPLETED" if code == 0 else "COMPLETED_WITH_FAILURES", "ingestion_exit_code": code, "ingestion_error": error,
        "index": summary, "index_warning_count": warnings.count(), "index_warnings": [r.asDict() for r in warnings.orderBy(*warnings.columns).limit(100).collect()],
    }
    write_document(index.spark, path, report)
    return report
