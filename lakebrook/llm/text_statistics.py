"""Counts and shape features of whole texts, for the quality rules and the quality classifier.

Every count runs over the whole text, in slices of bounded size (one text at least); null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernel as K

U = np.uint64
_LUT = {name: np.zeros(256, bool) for name in ("symbol", "upper", "lower", "digit", "punct", "high", "cont", "bang", "pipe")}
_LUT["symbol"][list(b"#*$%&|<>")] = True
_LUT["upper"][65:91] = True
_LUT["lower"][97:123] = True
_LUT["digit"][48:58] = True
_LUT["punct"][list(b".,;:!?'\"()-")] = True
_LUT["high"][128:] = True
_LUT["cont"][128:192] = True
_LUT["bang"][list(b"!?")] = True
_LUT["pipe"][list(b"|{}[]\\/=_~^`@+")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features in no unit that grows with the text, but for the first.
FEATURES = (
    "log_words", "word_length", "symbols_a_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_a_word",
    "high_share", "bang_share", "pipe_share", "distinct_share", "top_word_share", "words_a_line", "short_line_share", "ended_line_share",
    "single_char_share", "long_word_share", "adjacent_same_share", "capital_word_share", "length_spread",
)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x COUNTS as int64, rows x FEATURES as float) of a column of texts."""
    n = len(column)
    counts, features = np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(FEATURES)))
    for lo, hi, data, offsets in K.slices(column):
        counts[lo:hi], features[lo:hi] = _slice(data, offsets)
    return counts, features


def _slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs = len(offsets) - 1
    starts, ends, first = K.runs(~K.SPACE[data], offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(docs, dtype=np.int64), words)
    salt = K.mix(np.arange(1, docs + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    hashes = K.span_hashes(data, starts, ends)

    def tally(mask: np.ndarray) -> np.ndarray:
        return K.per_document(mask, offsets)

    continued = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LUT["cont"][data], out=continued[1:])
    lengths = (ends - starts) - (continued[ends] - continued[starts])
    chars = K.per_document(lengths, first)

    # windows of eight words found twice or more in their text, and the words that they cover
    covered = np.zeros(len(hashes) + 1, np.int64)
    eight = K.rolling(hashes, 8)
    if len(eight):
        at = np.flatnonzero(doc[: len(eight)] == doc[7:])
        many, _ = K.repeats(eight[at] ^ salt[doc[at]])
        hit = at[many]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + 8, 1)
    repeated = K.per_document(np.cumsum(covered[:-1]) > 0, first)

    # lines with a word: runs between line breaks; a carriage return is part of the line
    ls, le, lfirst = K.runs(data != 10, offsets)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lines = np.diff(lfirst)
    ldoc = np.repeat(np.arange(docs, dtype=np.int64), lines)
    _, later = K.repeats(K.span_hashes(data, ls[has], le[has]) ^ salt[ldoc[has]])
    dup = np.zeros(len(ls), bool)
    dup[np.flatnonzero(has)[later]] = True
    dups = K.per_document(dup, lfirst)
    real = K.per_document(has, lfirst)
    line_words = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
    ended = np.zeros(len(ls), bool)
    if len(ls):
        ended[:] = np.isin(data[le - 1], np.frombuffer(b".!?:\"", np.uint8))

    # occurrences of each word in its text
    keys = hashes ^ salt[doc]
    distinct, top = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    if len(keys):
        order = np.argsort(keys)
        edge = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        size = np.diff(np.append(edge, len(keys)))
        owner = doc[order[edge]]
        distinct = np.bincount(owner, minlength=docs)
        np.maximum.at(top, owner, size)
    adjacent = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        adjacent[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    symbols = tally(_LUT["symbol"][data])
    counts = np.stack([words, chars, symbols, dups, repeated], axis=1)
    w, c, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(real, 1)
    mean = chars / w
    capital = _LUT["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    square = K.per_document(lengths.astype(float) ** 2, first)
    features = np.stack(
        [
            np.log1p(words), mean, symbols / w, dups / ln, repeated / w, tally(_LUT["upper"][data]) / c, tally(_LUT["digit"][data]) / c, tally(_LUT["punct"][data]) / w,
            tally(_LUT["high"][data] & ~_LUT["cont"][data]) / c, tally(_LUT["bang"][data]) / w, tally(_LUT["pipe"][data]) / w, distinct / w, top / w, words / ln,
            K.per_document(has & (line_words < 4), lfirst) / ln, K.per_document(has & ended, lfirst) / ln,
            K.per_document(lengths == 1, first) / w, K.per_document(lengths > 16, first) / w, K.per_document(adjacent, first) / w, K.per_document(capital, first) / w,
            np.sqrt(np.maximum(square / w - mean**2, 0)),
        ],
        axis=1,
    )
    return counts, features
