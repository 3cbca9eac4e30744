"""Settings of a deployment: a JSON file of parameters held against rules, and KEY=VALUE files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

# Parameters and what they must be. A kind is a type and the range that its values lie in, ends included;
# "positive" numbers may be fractions, a "share" lies in (0, 1].
RULES = {
    "ingestion": {"default_window_days": "count", "max_window_days": "count", "short_video_max_seconds": "count", "screenshot_interval_seconds": "count"},
    "tools": {"yt_dlp": "text", "ffmpeg": "text", "whisper_script": "text", "ffprobe": "text"},
    "runtime": {"subprocess_timeout_seconds": "count"},
    "agent": {
        "max_rounds": "count", "max_minutes": "count", "max_model_calls": "count", "max_output_tokens": "count", "max_model_calls_ceiling": "count",
        "max_cost_usd": "positive", "max_cost_usd_per_task": "positive", "max_cost_usd_ceiling": "positive", "stop_at_budget_fraction": "share", "minimum_eval_pass_fraction": "share",
    },
    "digest": {"max_cost_usd_per_window_day": "positive"},
    "model_evaluation": {"max_minutes": "count", "max_model_calls": "count", "max_cost_usd": "positive", "stop_at_budget_fraction": "share"},
    "x": {
        "include_replies": "flag", "include_retweets": "flag", "max_results_per_request": "page", "download_media": "flag", "download_linked_documents": "flag",
        "max_media_bytes": "count", "max_document_bytes": "count", "download_timeout_seconds": "count", "post_read_cost_usd": "price", "user_read_cost_usd": "price",
    },
}


def _number(v: Any, *types: type) -> bool:
    return isinstance(v, types) and not isinstance(v, bool)


KINDS = {
    "count": lambda v: _number(v, int) and v >= 1,
    "page": lambda v: _number(v, int) and 5 <= v <= 100,
    "positive": lambda v: _number(v, int, float) and v > 0,
    "price": lambda v: _number(v, int, float) and v >= 0,
    "share": lambda v: _number(v, int, float) and 0 < v <= 1,
    "flag": lambda v: isinstance(v, bool),
    "text": lambda v: isinstance(v, str) and v != "",
}


def broken(parameters: dict[str, Any]) -> Iterator[str]:
    """Every parameter that breaks its rule, by its path and what it should be."""
    for section, rules in RULES.items():
        held = parameters.get(section)
        if not isinstance(held, dict):
            yield f"{section}: object"
            continue
        yield from (f"{section}.{name}: {kind}" for name, kind in rules.items() if not KINDS[kind](held.get(name)))
        if section == "ingestion" and all(KINDS["count"](held.get(n)) for n in ("default_window_days", "max_window_days")) and held["default_window_days"] > held["max_window_days"]:
            yield "ingestion.default_window_days: at most max_window_days"


def read_parameters(path: str | Path) -> dict[str, Any]:
    """The file's parameters; all that is wrong with them is told at once."""
    parameters = json.loads(Path(path).read_text(encoding="utf-8"))
    wrong = list(broken(parameters)) if isinstance(parameters, dict) else ["file: object"]
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return parameters


def entries(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """KEY, value of lines like `export KEY="value"`. Comments and lines of any other form are passed over; one pair of
    equal quotes around a value is taken off."""
    for line in lines:
        name, equals, value = line.strip().partition("=")
        name, value = name.removeprefix("export ").strip(), value.strip()
        if equals and name.isascii() and name.isidentifier():
            quoted = len(value) > 1 and value[0] in "\"'" and value.endswith(value[0])
            yield name, value[1:-1] if quoted else value


def read_env(path: str | Path, override: bool = False) -> bool:
    """Puts a file's entries into the environment; what is set there stays, unless overridden. False where there's no file."""
    path = Path(path)
    if not path.is_file():
        return False
    known = set() if override else set(os.environ)
    os.environ.update({k: v for k, v in entries(path.read_text(encoding="utf-8").splitlines()) if k not in known})
    return True
