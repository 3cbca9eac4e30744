"""What every loop tells about itself: its kind, its run, and events in one append-only log of JSON lines."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BEARER, MAX_STRING, SECRET_KEY, SIGNED_URL, redact, redact_map


class Kind(NamedTuple):
    #: Whether two runs on the same input may differ, and the kinds of runs that one of these may start.
    stochastic: bool
    children: tuple[str, ...] = ()


# The kinds of loops.
KINDS = {
    "SOURCE_INGESTION": Kind(False),
    "LIBRARY_UPDATE": Kind(False, ("SOURCE_INGESTION",)),
    "RESEARCH_QUERY": Kind(False),
    "AGENT_TASK": Kind(True, ("RESEARCH_QUERY",)),
    "DIGEST": Kind(True),
    "MODEL_EVALUATION": Kind(True, ("AGENT_TASK",)),
    "PROJECT_IMPROVEMENT": Kind(True),
}


def new_run(kind: str, parent: str | None = None) -> dict[str, str]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of loop: {kind}")
    return {"loop_type": kind, "run_id": uuid.uuid4().hex, **({"parent_run_id": parent} if parent else {})}


def chosen(settings: Mapping[str, str], domains: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """One value for each declared option. domains: an option's values, its default first. All options are looked at before
    anything is requested, and all that are wrong are told at once."""
    taken = {name: settings.get(name, "").strip().lower() or domain[0] for name, domain in domains.items()}
    wrong = {name: value for name, value in taken.items() if value not in domains[name]}
    if wrong:
        raise ValueError("; ".join(f"{name}: {value} is none of {', '.join(domains[name])}" for name, value in wrong.items()))
    return taken


HIDDEN = "[REDACTED]"
_secret = re.compile(SECRET_KEY, re.IGNORECASE)
#: What functions.text.redact does to strings, for those that the driver holds.
_PATTERNS = ((re.compile(SIGNED_URL), r"\1[QUERY_REDACTED]"), (re.compile(BEARER), rf"\1{HIDDEN}"))


def _cells(tree: Any) -> Iterator[tuple[Any, Any, bool]]:
    """(container, place, hidden) of every value below tree, which is plain JSON: hidden where its key names a secret, or
    where it follows a flag that does."""
    open_nodes = [tree]
    while open_nodes:
        node = open_nodes.pop()
        flagged = [False, *(isinstance(x, str) and x.startswith("--") and bool(_secret.search(x)) for x in node)] if isinstance(node, list) else []
        for place in list(node) if isinstance(node, dict) else range(len(node)):
            hidden = bool(_secret.search(place)) if isinstance(node, dict) else flagged[place]
            yield node, place, hidden
            if isinstance(node[place], dict | list):
                open_nodes.append(node[place])


def safe(value: Any) -> Any:
    """A plain copy of any value, as JSON has it, without secrets and with long strings cut."""
    tree = [json.loads(json.dumps(value, ensure_ascii=False, default=str))]
    for node, place, hidden in _cells(tree):
        if hidden:
            node[place] = HIDDEN
        elif isinstance(node[place], str):
            for pattern, instead in _PATTERNS:
                node[place] = pattern.sub(instead, node[place])
            node[place] = node[place][:MAX_STRING] + "...[TRUNCATED]" * (len(node[place]) > MAX_STRING)
    return tree[0]


# The keys of an event, in the log's order.
EVENT_KEYS = (
    "run_id", "loop_type", "event_id", "parent_event_id", "logged_at", "started_at", "ended_at", "duration_ms",
    "operation", "stage", "category", "status", "parameters", "output", "error", "artifact_paths",
)


class RunLog:
    """The driver's events. Each is one line, written whole under a lock; secrets are taken out before."""

    def __init__(self, path: str | Path, run: Mapping[str, str]):
        self.path, self.run, self._lock = Path(path), dict(run), threading.Lock()
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def event(self, stage: str, category: str = "INFO", **told: Any) -> str:
        unknown = set(told) - set(EVENT_KEYS)
        if unknown:
            raise ValueError(f"an event has no {sorted(unknown)}")
        known = {"run_id": self.run["run_id"], "loop_type": self.run["loop_type"], "event_id": uuid.uuid4().hex, "logged_at": datetime.now(timezone.utc).isoformat()}
        hidden = {k: safe(told.get(k)) for k in ("parameters", "output", "error")} | {"artifact_paths": safe(told.get("artifact_paths") or [])}
        row = dict.fromkeys(EVENT_KEYS) | told | known | hidden | {"stage": stage, "category": category}
        line = json.dumps(row, ensure_ascii=False, default=str) + "\n"
        with self._lock, open(self.path, "a", encoding="utf-8") as f:
            f.write(line)
        return known["event_id"]


def append_events(events: DataFrame, path: str) -> None:
    """Events of many executors at once, appended to a log's folder: string columns and maps of strings are redacted."""
    cleaned = []
    for name, kind in events.dtypes:
        if _secret.search(name):
            cleaned.append(F.lit(HIDDEN).alias(name))
        else:
            cleaned.append({"string": redact, "map<string,string>": redact_map}.get(kind, lambda c: c)(F.col(f"`{name}`")).alias(name))
    events.select(*cleaned).write.mode("append").json(path)
