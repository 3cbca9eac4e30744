"""Vectorised text primitives over Arrow string columns: words, lines and rolling hashes, without a Python object a word.

Hashes are 64 bits wide: a polynomial of the bytes modulo 2**64, then mixed. Two different words or lines of one text
get the same hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: White space of the contracts: a blank and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        grown = np.full(max(n, 1 << 20), _BASE if which == "up" else _INVERSE, U)
        grown[0] = 1
        _powers[which] = np.multiply.accumulate(grown)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most `most` bytes, or of one longer row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross documents, and for each document its first run (one more at the end)."""
    n = len(inside)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes, in order."""
    if len(hashes) < k:
        return np.empty(0, U)
    out = np.zeros(len(hashes) - k + 1, U)
    for j in range(k):
        out += hashes[j : len(hashes) - k + 1 + j] * U((0xA0761D6478BD642F * (2 * j + 1) + 0xE7037ED1A0B428DB * j * j) % (1 << 64) | 1)
    return mix(out)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each document's span of items."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype != float else float)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether an equal key stands before it."""
    n = len(keys)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later
