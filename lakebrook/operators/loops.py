"""Bounded loops around an injected model client: budgets, checkpoints, resumable batches, retrieval retries.

Control stays on the driver: it decides when to stop, what to merge and what is valid. A loop's units are bounded by its
budget, so what it holds is too; large batches are judged by columns (functions.validation) instead.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


def cache_key(**inputs: Any) -> str:
    """Of every input that can change a result."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def write_atomic(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


@dataclass(frozen=True)
class Budget:
    """Limits of one loop. It stops before a unit once a share of the calls, the cost or the time is spent."""

    calls: int
    cost: float
    minutes: float
    share: float = 0.8

    def __post_init__(self) -> None:
        if min(self.calls, self.cost, self.minutes) <= 0 or not 0 < self.share <= 1:
            raise ValueError("limits must be positive and the share within (0, 1]")

    @classmethod
    def fitted(cls, units: int, cost: float, minutes: float, share: float = 0.8, least: int = 1, most: int = 10_000) -> "Budget":
        """Calls that leave room for one more than the units."""
        return cls(min(max(math.ceil((units + 1) / share), least), most), cost / share, minutes, share)


@dataclass
class Progress:
    key: str
    outcome: str = "RUNNING"
    done: dict[str, Any] = field(default_factory=dict)
    rejected: dict[str, str] = field(default_factory=dict)
    calls: int = 0
    cost: float = 0.0


class Checkpoints:
    """One JSON file a loop. A broken file counts as none; a finished result is reused, an unfinished one resumed."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self, key: str) -> Progress | None:
        try:
            state = json.loads(self.path.read_text(encoding="utf-8"))
            return Progress(**state) if state.get("key") == key else None
        except (OSError, ValueError, TypeError, AttributeError):
            return None

    def save(self, progress: Progress) -> None:
        write_atomic(self.path, json.dumps(progress.__dict__, sort_keys=True, ensure_ascii=False))


class Rejected(Exception):
    """A unit's output broke a rule; the unit may be tried again."""


def run_units(
    units: Iterable[tuple[str, Any]], key: str, budget: Budget, store: Checkpoints,
    perform: Callable[[Any], tuple[Any, float]], retries: int = 1, clock: Callable[[], float] = time.monotonic,
) -> Progress:
    """perform(unit) gives (result, cost) or raises Rejected. State is saved before and after every unit.

    Ends as COMPLETED, PARTIAL (some units rejected for good) or BUDGET_STOP; a unit that has a result isn't done again,
    and a result wins over an earlier rejection.
    """
    progress = store.load(key) or Progress(key)
    if progress.outcome == "COMPLETED":
        return progress
    progress.outcome, began = "RUNNING", clock()
    for name, unit in units:
        if name in progress.done:
            continue
        progress.rejected.pop(name, None)
        for attempt in range(1 + retries):
            spent = (progress.calls >= budget.share * budget.calls, progress.cost >= budget.share * budget.cost, clock() - began >= 60 * budget.share * budget.minutes)
            if any(spent):
                progress.outcome = "BUDGET_STOP"
                store.save(progress)
                return progress
            store.save(progress)
            progress.calls += 1
            try:
                result, cost = perform(unit)
            except Rejected as e:
                progress.rejected[name] = str(e)
                continue
            progress.cost = round(progress.cost + cost, 8)
            progress.done[name] = result
            progress.rejected.pop(name, None)
            break
        store.save(progress)
    progress.outcome = "PARTIAL" if progress.rejected else "COMPLETED"
    store.save(progress)
    return progress


def merge_capped(existing: list[dict], additions: list[dict], cap: int) -> list[dict]:
    """additions by rank after what is there, each id once, up to cap; what is there is never dropped."""
    merged, seen = list(existing), {e["evidence_id"] for e in existing}
    for item in additions:
        if item["evidence_id"] is None:
            raise ValueError("evidence without an id")
        if item["evidence_id"] not in seen and len(merged) < cap:
            seen.add(item["evidence_id"])
            merged.append(item)
    return merged


def retrieval_retry(
    question: str, evidence: list[dict], answer: Callable[[str, list[dict]], dict], retrieve: Callable[[str], list[dict]], rounds: int = 2, cap: int = 25,
) -> dict:
    """Answers, looks at what was thin, retrieves more by the answer's own queries, and answers again.

    answer() gives classification, relevant (count) and suggested_queries. It asks again while the answer is insufficient
    or fewer than three (or than all) pieces were relevant.
    """
    history: list[dict] = []
    for _ in range(rounds):
        result = answer(question, evidence)
        history.append(result)
        thin = result["relevant"] < min(3, len(evidence))
        if result["classification"] != "INSUFFICIENT_EVIDENCE" and not thin:
            return {"rounds": history, "evidence": evidence, "stop": "QUALITY_GATE_PASSED"}
        if not result["suggested_queries"]:
            return {"rounds": history, "evidence": evidence, "stop": "RETRIEVAL_RETRY_NOT_REQUESTED"}
        more = [hit for query in result["suggested_queries"] for hit in retrieve(query)]
        grown = merge_capped(evidence, more, cap)
        if len(grown) == len(evidence):
            return {"rounds": history, "evidence": evidence, "stop": "RETRIEVAL_NO_NEW_EVIDENCE"}
        evidence = grown
    return {"rounds": history, "evidence": evidence, "stop": "RETRIEVAL_ROUND_LIMIT"}
