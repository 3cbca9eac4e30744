"""Experiments with models: synthesis, provider comparison, suites, retrieval triggers, claim drafts, blind audits.

A client is a function of a prompt that gives (text, cost). Calls and caps are the driver's; what the calls gave is judged
and summed up as DataFrames, so that reports of any number of runs are read the same way.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import product
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SCOPE_NEGATION, SCOPE_PATTERNS, normalize_ws, passage_context
from ..functions.validation import decision_error
from .controllers import CLASSES, ProviderError, Task, agent_task
from .evaluation import allocations, rate, stratified_sample
from .loops import Budget, Checkpoints, Progress, Rejected, cache_key, retrieval_retry, run_units, write_atomic
from .runs import new_run

Client = Callable[[str], tuple[str, float]]
UNBOUNDED = 10**12


class Metered:
    """A client that counts its calls and what they cost, failed ones too where the failure names a cost."""

    def __init__(self, client: Client):
        self.client, self.calls, self.cost = client, 0, 0.0

    def __call__(self, prompt: str) -> tuple[str, float]:
        self.calls += 1
        try:
            text, cost = self.client(prompt)
        except Exception as e:
            self.cost += getattr(e, "cost", 0.0)
            raise
        self.cost += cost
        return text, cost


def object_in(raw: str) -> dict[str, Any]:
    """The JSON object that a reply is, has in a fence, or has among other words: the first that parses."""
    reader = json.JSONDecoder()
    for brace in re.finditer(r"\{", raw):
        try:
            value, _ = reader.raw_decode(raw, brace.start())
        except json.JSONDecodeError:
            continue
        return value
    raise Rejected("NOT_AN_OBJECT")


def _text(v: Any) -> bool:
    return isinstance(v, str) and v.strip() != ""


def _claims_too_much(answer: str) -> bool:
    """The driver's twin of functions.text.scope_violations."""
    found = (m.start() for p in SCOPE_PATTERNS for m in re.finditer(p, answer, re.IGNORECASE))
    return any(not re.search(SCOPE_NEGATION, answer[max(0, at - 80) : at], re.IGNORECASE) for at in found)


def synthesis_error(said: Mapping[str, Any], supplied: Iterable[str]) -> str | None:
    """The first rule that an answer over the supplied evidence breaks, or None."""
    supplied = set(supplied)
    cited, judged, queries = (said.get(k) for k in ("citation_ids", "evidence_assessment", "suggested_queries"))
    queries = [] if queries is None else queries
    rules = (
        ("EMPTY_ANSWER", lambda: _text(said.get("answer"))),
        ("UNKNOWN_CLASSIFICATION", lambda: said.get("classification") in CLASSES),
        ("NO_CITATION", lambda: isinstance(cited, list) and cited),
        ("UNKNOWN_CITATION", lambda: {str(c) for c in cited} <= supplied),
        ("BAD_QUERIES", lambda: isinstance(queries, list) and len(queries) <= 3 and all(map(_text, queries))),
        ("NOT_EXACT_COVER", lambda: isinstance(judged, list) and all(isinstance(j, dict) for j in judged) and sorted(str(j.get("evidence_id")) for j in judged) == sorted(supplied)),
        ("BAD_ASSESSMENT", lambda: all(isinstance(j.get("relevant"), bool) and _text(j.get("reason")) for j in judged)),
        ("UNSUPPORTED_SCOPE", lambda: not _claims_too_much(said["answer"])),
    )
    return next((name for name, holds in rules if not holds()), None)


def synthesise(question: str, evidence: Sequence[Mapping[str, Any]], client: Client, render: Callable[[str, Sequence, str], str], feedback: str = "") -> tuple[dict[str, Any], float]:
    """(answer, cost) of one call over the evidence; raises Rejected with the broken rule. With client and render bound it
    is what agent_task asks."""
    if not question.strip() or not evidence:
        raise ValueError("a question and evidence are needed")
    raw, cost = client(render(question, evidence, feedback))
    said = object_in(raw)
    wrong = synthesis_error(said, [str(e["evidence_id"]) for e in evidence])
    if wrong:
        raise Rejected(wrong)
    relevant = sum(j["relevant"] for j in said["evidence_assessment"])
    queries = [query.strip() for query in said.get("suggested_queries") or ()]
    return {**said, "answer": said["answer"].strip(), "citation_ids": [str(c) for c in said["citation_ids"]], "suggested_queries": queries, "relevant": relevant}, cost


RESULT = (
    "provider string, case_id string, repetition int, expected string, required array<string>, forbidden array<string>, outcome string, stop_reason string, "
    "classification string, cited array<string>, rounds int, model_calls int, cost_usd double, seconds double"
)
ENDS = {  # how each outcome's run must have stopped
    "COMPLETED": "QUALITY_GATE_PASSED", "COMPLETED_AFTER_RETRY": "QUALITY_GATE_PASSED", "INSUFFICIENT_EVIDENCE": "QUALITY_GATE_PASSED",
    "CONFLICTING_EVIDENCE": "QUALITY_GATE_PASSED", "FAILED_BUDGET": "BUDGET_EXHAUSTED", "ESCALATED_FOR_REVIEW": "QUALITY_GATE_NOT_REACHED",
}


def _row(provider: str, case: Mapping[str, Any], repetition: int, got: Mapping[str, Any], seconds: float) -> dict[str, Any]:
    last = next((a["answer"] for a in reversed(got["attempts"]) if a["answer"]), {})
    return {
        "provider": provider, "case_id": case["case_id"], "repetition": repetition, "expected": case.get("expected_outcome"),
        "required": list(case.get("required_citation_ids") or ()), "forbidden": list(case.get("forbidden_citation_ids") or ()), "outcome": got["outcome"],
        "stop_reason": got["stop_reason"], "classification": last.get("classification"), "cited": list(last.get("citation_ids") or ()),
        "rounds": len(got["attempts"]), "model_calls": got["model_calls"], "cost_usd": float(got["cost_usd"]), "seconds": round(seconds, 3),
    }


def summary(results: DataFrame, rounds: int) -> DataFrame:
    """One row a provider of results (RESULT): rates are ratios of sums over the runs that they apply to, null for none.
    `rounds` is the most calls that a run may have made."""
    passed = F.col("outcome").isin(*[k for k, v in ENDS.items() if v == "QUALITY_GATE_PASSED"])
    missing = F.size(F.array_except("required", "cited"))
    hit = F.size(F.array_intersect("forbidden", "cited"))
    ended = F.coalesce(*[F.when(F.col("outcome") == k, F.col("stop_reason") == v) for k, v in ENDS.items()], F.lit(False))
    share = lambda holds, of: rate(F.count_if(holds & of), F.count_if(of), 4)
    agree = results.groupBy("provider", "case_id").agg((F.count_distinct(F.coalesce("classification", F.lit(""))) == 1).alias("same")).groupBy("provider").agg(rate(F.count_if("same"), F.count("*"), 4).alias("consistency_rate"))
    told = results.groupBy("provider").agg(
        F.count("*").alias("cases"), F.count_if(passed).alias("passed"), rate(F.count_if(passed), F.count("*"), 4).alias("pass_rate"),
        F.count_if(F.col("outcome") == "ESCALATED_FOR_REVIEW").alias("escalated"), F.count_if(F.col("outcome") == "FAILED_BUDGET").alias("budget_failures"),
        F.sum(F.greatest(F.col("rounds") - 1, F.lit(0))).alias("retries"), F.coalesce(F.sum(F.when(passed, F.greatest(F.col("rounds") - 1, F.lit(0)))), F.lit(0)).alias("retries_to_pass"),
        F.sum("model_calls").alias("model_calls"), F.round(F.sum("cost_usd"), 8).alias("cost_usd"), F.round(F.sum("seconds"), 3).alias("seconds"),
        share(F.coalesce(F.col("outcome") == F.col("expected"), F.lit(False)), F.col("expected").isNotNull()).alias("expected_rate"),
        share(missing == 0, F.size("required") > 0).alias("completeness_accuracy"), share(hit == 0, F.size("forbidden") > 0).alias("unsupported_claim_accuracy"),
        F.sort_array(F.collect_set(F.when(missing > 0, F.col("case_id")))).alias("completeness_failures"), F.sort_array(F.collect_set(F.when(hit > 0, F.col("case_id")))).alias("unsupported_claim_failures"),
        rate(F.count_if(ended & F.col("model_calls").between(1, rounds)), F.count("*"), 4).alias("stopping_compliance"),
    )
    return told.join(agree, "provider")


def compare_providers(
    spark: SparkSession, cases: Sequence[Mapping[str, Any]], providers: Mapping[str, tuple[str, Callable]], folder: str | Path, budget: Budget,
    task: Callable[[Mapping[str, Any]], Task], repetitions: int = 1, clock: Callable[[], float] = time.monotonic,
) -> tuple[dict[str, Any], DataFrame]:
    """(report, results) of every case under every provider: name -> (model, ask), the same tasks and evidence for all.

    The comparison ends after the run with which a share of its budget is spent; it is then marked as incomplete.
    """
    if len(providers) < 2 or repetitions < 1 or not cases:
        raise ValueError("a comparison needs two providers, a case and a repetition")
    run, began, rows, stop = new_run("MODEL_EVALUATION"), clock(), [], "SUITE_COMPLETED"
    for name, case, n in product(providers, cases, range(1, repetitions + 1)):
        model, ask = providers[name]
        at = clock()
        got = agent_task(task(case), case["evidence"], ask, Checkpoints(Path(folder) / name / str(n) / f"{case['case_id']}.json"), model)
        rows.append(_row(name, case, n, got, clock() - at))
        calls, cost = sum(r["model_calls"] for r in rows), sum(r["cost_usd"] for r in rows)
        if calls >= budget.share * budget.calls or cost >= budget.share * budget.cost or clock() - began >= 60 * budget.share * budget.minutes:
            stop = "SUITE_COMPLETED" if len(rows) == len(providers) * len(cases) * repetitions else "SUITE_BUDGET_EXHAUSTED"
            break
    results = spark.createDataFrame(rows, RESULT)
    told = {r["provider"]: r.asDict() for r in summary(results, max(task(c).rounds for c in cases)).collect()}
    done = stop == "SUITE_COMPLETED"
    report = {**run, "stop_reason": stop, "complete": done, "same_cases": done, "providers": {p: {"model": providers[p][0], "summary": told[p]} for p in told}}
    write_atomic(Path(folder) / "report.json", json.dumps(report, indent=2, ensure_ascii=False) + "\n")
    return report, results


def run_suite(
    spark: SparkSession, cases: Sequence[Mapping[str, Any]], ask: Callable, folder: str | Path, model: str, max_cost: float,
    task: Callable[[Mapping[str, Any]], Task], repetitions: int = 1, version: str = "", clock: Callable[[], float] = time.monotonic,
) -> tuple[dict[str, Any], DataFrame]:
    """(report, results) of a suite that may be stopped and resumed: tasks that ended aren't run again, and none begins once
    the cost is spent. Another suite, model, version or number of repetitions begins anew."""
    if repetitions < 1 or max_cost <= 0:
        raise ValueError("a suite needs a repetition and a positive cost")
    for case in cases:
        if not (_text(case.get("case_id")) and _text(case.get("question")) and case.get("evidence")):
            raise ValueError(f"case {case.get('case_id')!r} lacks an id, a question or evidence")
    key = cache_key(loop="SUITE", cases=list(cases), model=model, version=version, repetitions=repetitions)
    place = Path(folder) / key[:16]

    def perform(unit: tuple[Mapping[str, Any], int]) -> tuple[dict, float]:
        case, n = unit
        at = clock()
        got = agent_task(task(case), case["evidence"], ask, Checkpoints(place / case["case_id"] / f"{n}.json"), model)
        return _row(model, case, n, got, clock() - at) | {"cache_hit": got["cache_hit"]}, float(got["cost_usd"])

    units = ((f"{case['case_id']}#{n}", (case, n)) for case, n in product(cases, range(1, repetitions + 1)))
    ended: Progress = run_units(units, key, Budget(UNBOUNDED, max_cost, UNBOUNDED, 1.0), Checkpoints(place / "state.json"), perform, retries=0)
    rows = sorted(ended.done.values(), key=lambda r: (r["case_id"], r["repetition"]))
    results = spark.createDataFrame([{k: v for k, v in r.items() if k != "cache_hit"} for r in rows], RESULT)
    report = {
        **new_run("MODEL_EVALUATION"), "key": key, "model": model, "version": version, "repetitions": repetitions, "max_cost_usd": max_cost, "total_cost_usd": ended.cost,
        "suite_stop_reason": "SUITE_COST_BUDGET_EXHAUSTED" if ended.outcome == "BUDGET_STOP" else "SUITE_COMPLETE", "completed_tasks": len(rows),
        "total_tasks": len(cases) * repetitions, "cache_hit_count": sum(r["cache_hit"] for r in rows), "results": rows,
    }
    write_atomic(place / "report.json", json.dumps(report, indent=2, ensure_ascii=False) + "\n")
    return report, results


TRACE = "case_id string, repetition int, rounds int, classification string, relevant int, expanded boolean, stop_reason string, error string, calls int, cost_usd double, seconds double"


def measure_triggers(
    spark: SparkSession, cases: Sequence[Mapping[str, Any]], client: Client, answer: Callable[[Client], Callable], retrieve: Callable[[str], list[dict]],
    folder: str | Path, max_cost: float, repetitions: int = 5, clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """A row (TRACE) for each run of the retrieval loop: what its first round said and whether evidence was added. Each trace
    is written when it ends. No run begins once the cost is spent, or after a refusal that asking again can't mend."""
    rows: list[dict[str, Any]] = []
    for case, n in product(cases, range(1, repetitions + 1)):
        if sum(r["cost_usd"] for r in rows) >= max_cost:
            break
        metered, at, refused, error = Metered(client), clock(), False, None
        trace: dict[str, Any] = {"rounds": [], "evidence": list(case["evidence"]), "stop": "ERROR"}
        try:
            trace = retrieval_retry(case["question"], list(case["evidence"]), answer(metered), retrieve)
        except (Rejected, ProviderError) as e:
            error, refused = f"{type(e).__name__}: {e}", isinstance(e, ProviderError) and not e.retryable
        first = trace["rounds"][0] if trace["rounds"] else {}
        rows.append({
            "case_id": case["case_id"], "repetition": n, "rounds": len(trace["rounds"]), "classification": first.get("classification"), "relevant": first.get("relevant"),
            "expanded": len(trace["evidence"]) > len(case["evidence"]), "stop_reason": trace["stop"], "error": error, "calls": metered.calls,
            "cost_usd": round(metered.cost, 6), "seconds": round(clock() - at, 3),
        })
        write_atomic(Path(folder) / f"{case['case_id']}-rep-{n}.json", json.dumps(rows[-1] | {"trace": trace}, ensure_ascii=False, indent=2) + "\n")
        if refused:
            break
    return spark.createDataFrame(rows, TRACE)


VERDICTS = ("proven", "not_proven", "unclear")  # fixed values
CLAIM = "claim string, verdict string, evidence_id string, quote string"


def checked_claims(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """proposals (CLAIM) with quote_valid and flag: a quote that its evidence (evidence_id, snippet) doesn't hold makes the
    verdict unclear; case counts, white space doesn't. Incomplete proposals and those of another verdict are left out by draft_claims before."""
    known = evidence.groupBy("evidence_id").agg(F.max("snippet").alias("snippet"))
    held = F.coalesce(F.contains(normalize_ws(F.col("snippet")), normalize_ws(F.col("quote"))), F.lit(False))
    flag = F.when(F.col("unknown"), "unknown_evidence_id").when(~held, "quote_not_found_in_evidence_snippet")
    met = proposals.join(known.withColumn("found", F.lit(True)), "evidence_id", "left").withColumn("unknown", F.col("found").isNull())
    verdict = F.when(held, F.col("verdict")).otherwise("unclear").alias("verdict")
    rest = [c for c in proposals.columns if c not in ("verdict",)]
    return met.select(*rest, verdict, held.alias("quote_valid"), flag.alias("flag"))


def draft_claims(spark: SparkSession, trace: Mapping[str, Any], client: Client, render: Callable[[str, str, Sequence], str], model: str) -> dict[str, Any]:
    """Claims of a trace's last answer with the verdict that a model proposes for each; a person decides."""
    said = next((a["answer"] for a in reversed(trace.get("attempts") or []) if a.get("answer")), None)
    evidence = trace.get("evidence") or []
    if not said or not _text(said.get("answer")) or not evidence or not all(e.get("evidence_id") for e in evidence):
        raise ValueError("a trace needs an answer and evidence with ids")
    raw, cost = client(render(trace.get("question") or "", said["answer"], evidence))
    proposed = object_in(raw).get("claims")
    if not isinstance(proposed, list) or not all(isinstance(p, dict) for p in proposed):
        raise Rejected("NO_CLAIMS")
    rows = [{k: str(p.get(k) or "").strip() for k in ("claim", "verdict", "evidence_id", "quote")} | {"place": i} for i, p in enumerate(proposed)]
    rows = [r | {"verdict": r["verdict"].lower()} for r in rows]
    if not all(r["verdict"] in VERDICTS and r["claim"] and r["evidence_id"] and r["quote"] for r in rows):
        raise Rejected("BAD_CLAIM")
    snippets = spark.createDataFrame([(str(e["evidence_id"]), str(e.get("snippet") or "")) for e in evidence], "evidence_id string, snippet string")
    checked = checked_claims(spark.createDataFrame(rows, CLAIM + ", place int"), snippets).orderBy("place").drop("place")
    return {"question": trace.get("question"), "answer": said["answer"], "model": model, "cost_usd": cost, "claims": [r.asDict() for r in checked.collect()], "advisory_only": True}


def audit_cards(assessments: DataFrame, items: DataFrame, labels: Sequence[str], size: int = 20, seed: str = "audit", context: int = 600) -> DataFrame:
    """Blind cards of a balanced sample of assessments (evidence_id, label, claimed_change, supporting_evidence): the claim
    and its quotes where they stand in the item's text, without the model's reason and label. Only sampled texts are sent."""
    counts = {r["label"]: r["count"] for r in assessments.groupBy("label").count().collect()}
    if set(counts) - set(labels):
        raise ValueError(f"unknown labels: {sorted(set(counts) - set(labels), key=str)}")
    if not assessments.groupBy("evidence_id").count().where("count > 1").isEmpty():
        raise ValueError("an item was assessed twice")
    sample = stratified_sample(assessments, "label", "evidence_id", allocations(counts, size, labels), seed)
    cards = sample.join(items.select("evidence_id", "text"), "evidence_id", "left")
    if not cards.where("text is null or trim(text) = ''").isEmpty():
        raise ValueError("a sampled item has no text to review")
    quotes = F.transform("supporting_evidence", lambda e: F.struct(e["claim_component"].alias("claim_component"), passage_context(F.col("text"), e["quote"], context).alias("at")))
    sha = lambda c: F.sha2(c, 256)
    return cards.select(
        F.col("evidence_id").alias("audit_id"), F.col("claimed_change").alias("claim"), quotes.alias("evidence"), sha(F.col("claimed_change")).alias("claim_sha256"),
        sha(F.to_json("supporting_evidence")).alias("evidence_sha256"), sha(F.col("text")).alias("text_sha256"),
    ).orderBy(sha(F.concat(F.lit(seed + ":"), F.col("audit_id").cast("string"))))


def decision_errors(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """audit_id, error of blind decisions (audit_id, claim_sha256, evidence_sha256, scope, support, label, rationale) that
    can't stand: of no card, of a card that changed, made twice, without a reason, or against the rules of a decision."""
    made = decisions.groupBy("audit_id").agg(F.count("*").alias("n"))
    met = decisions.join(made, "audit_id").join(cards.select("audit_id", F.col("claim_sha256").alias("c"), F.col("evidence_sha256").alias("e")), "audit_id", "left")
    changed = ~(F.col("claim_sha256").eqNullSafe(F.col("c")) & F.col("evidence_sha256").eqNullSafe(F.col("e")))
    error = (
        F.when(F.col("c").isNull() & F.col("e").isNull(), "UNKNOWN_CARD").when(changed, "CARD_CHANGED").when(F.col("n") > 1, "DECIDED_TWICE")
        .when(F.coalesce(normalize_ws(F.col("rationale")), F.lit("")) == "", "NO_RATIONALE").otherwise(decision_error(F.col("scope"), F.col("support"), F.col("label")))
    )
    return met.select("audit_id", error.alias("error")).where("error is not null").distinct()


def audit_report(cards: DataFrame, decisions: DataFrame, assessments: DataFrame) -> dict[str, Any]:
    """Counts and rates of a finished audit; labels are put beside the model's only here."""
    wrong = decision_errors(cards, decisions)
    if not wrong.isEmpty():
        raise ValueError(f"decisions that can't stand: {[tuple(r) for r in wrong.orderBy('audit_id', 'error').limit(10).collect()]}")
    hidden = assessments.select(F.col("evidence_id").alias("audit_id"), F.col("label").alias("model_label"))
    both = cards.select("audit_id").join(hidden, "audit_id").join(decisions, "audit_id", "left")
    inside = F.coalesce(F.col("scope") == "IN_SCOPE", F.lit(False))
    supported = F.coalesce(F.col("support") == "SUPPORTED", F.lit(False))
    same = F.coalesce(F.col("label") == F.col("model_label"), F.lit(False))
    return both.agg(
        F.count("*").alias("cards"), F.count_if(F.col("scope").isNotNull()).alias("decided"), F.count_if(inside).alias("in_scope"),
        rate(F.count_if(inside & same), F.count_if(inside), 4).alias("match_rate"), rate(F.count_if(inside & supported), F.count_if(inside), 4).alias("support_rate"),
    ).first().asDict()


def ingest(sources: DataFrame, collect: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], schema: str, keys: Sequence[str], path: str) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of every source, read by Spark's tasks side by side and written once to a new folder. collect(source)
    yields records of `schema`, which holds no key; one source's failure is a row (keys, error) and costs no other source
    anything: what it yielded before stays. The caller merges the records with state.upsert: one writer, after all sources."""
    names = sources.sparkSession.createDataFrame([], schema).columns
    columns = [*keys, *names, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch.to_dict("records"):
                who, part = [source[k] for k in keys], []
                try:
                    for record in collect(source):
                        part.append([*who, *(record.get(n) for n in names), None])
                        if len(part) == 1000:
                            yield pd.DataFrame(part, columns=columns, dtype=object)
                            part = []
                except Exception as e:  # a source that fails is a result
                    part.append([*who, *(None for _ in names), f"{type(e).__name__}: {e}"])
                if part:
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    kinds = dict(sources.dtypes)
    spread = sources.repartition(sources.sparkSession.sparkContext.defaultParallelism, *keys)
    spread.mapInPandas(run, f"{', '.join(f'`{k}` {kinds[k]}' for k in keys)}, {schema}, error string").write.parquet(path)
    got = sources.sparkSession.read.parquet(path)
    return got.where("error is null").drop("error"), got.where("error is not null").select(*keys, "error")
