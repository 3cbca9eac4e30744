"""Listings behind a service, through an injected request: pages by token, look-ups in batches, users by name."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from typing import Any

PAGE, BATCH, TRIES, WAIT = 50, 100, 3, 0.25  # fixed values of the services: items a page, ids a look-up, tries, seconds


class SourceError(RuntimeError):
    """A service answered with an error, with no object, or not at all."""


def answered(request: Callable[[dict], Any], parameters: dict, wait: Callable[[float], None] = time.sleep) -> dict:
    """The service's answer. A request that doesn't get through is sent again, after a time that doubles."""
    for n in range(TRIES):
        try:
            answer = request(parameters)
            break
        except OSError as e:  # URLError and TimeoutError are OSErrors
            if n + 1 == TRIES:
                raise SourceError(f"no answer in {TRIES} tries: {e}") from e
            wait(WAIT * 2**n)
    if not isinstance(answer, dict) or "error" in answer:
        raise SourceError(f"the service answered with {answer['error'] if isinstance(answer, dict) else type(answer).__name__}")
    return answer


def pages(request: Callable[[dict], Any], parameters: dict, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All items of a listing, page by page; a service that repeats a token would never end, and is an error."""
    token, seen = None, set()
    while True:
        answer = answered(request, {**parameters, "maxResults": PAGE, **({"pageToken": token} if token else {})}, wait)
        yield from answer.get("items") or ()
        token = answer.get("nextPageToken")
        if not token:
            return
        if token in seen:
            raise SourceError("a page token came twice")
        seen.add(token)


def looked_up(request: Callable[[dict], Any], ids: Iterable[str], wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of the ids, each asked for once, BATCH to a request."""
    for some in batched(dict.fromkeys(ids), BATCH):
        yield from answered(request, {"ids": ",".join(some)}, wait).get("data") or ()


def user_id(name: str, known: dict[str, str], resolve: Callable[[str], str | None]) -> str:
    """The id of a user's name, of those known or from the service. A name that stands for another id now is an error."""
    key = name.strip().lstrip("@").lower()
    if key not in known:
        found = resolve(key)
        if not found:
            raise SourceError(f"no user {key}")
        remember(key, found, known)
    return known[key]


def remember(name: str, found: str, known: dict[str, str]) -> None:
    if known.setdefault(name, found) != found:
        raise SourceError(f"{name} was {known[name]} and is {found} now")
