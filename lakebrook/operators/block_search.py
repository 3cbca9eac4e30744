"""Top-k search in one shard of an index whose postings come in blocks with bounds on their gains.

A block holds up to BLOCK postings of one term, in order of chunk numbers, and pairs (tf, dl) such that each of its
postings has, in one of the pairs, a tf at least its own and a dl at most its own; the best gain of a pair is a bound for
whatever average length the corpus has by then. A query's terms are taken by falling bounds. While terms to come may still
carry a chunk among the k best items by themselves, a term's blocks add chunks; blocks whose bound can't are passed over.
From there on only blocks that hold a chunk still in question are read. The floor is the k-th best item by what is known.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

K1, B = 1.2, 0.75
BLOCK = 128
#: Scores are rounded to 6 places before they are ranked.
PLACES, SLACK = 6, 2e-6


def gain(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def frontiers(tf: np.ndarray, dl: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block edges[b]:edges[b + 1], the pairs (tf, dl) that no other one bounds, by falling tf and falling dl: tf,
    dl and the pairs' edges."""
    block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((dl, -tf, block))
    tf, dl, block = tf[order], dl[order], block[order]
    # a later block's lengths are all below an earlier one's, so that a running least starts anew with each block
    lowered = dl.astype(np.int64) - block * (int(dl.max(initial=0)) + 1)
    least = np.minimum.accumulate(lowered)
    kept = np.r_[True, lowered[1:] < least[:-1]] if len(dl) else np.empty(0, bool)
    return tf[kept], dl[kept], np.r_[0, np.cumsum(np.bincount(block[kept], minlength=len(edges) - 1))]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0], ..., ends[0] - 1, starts[1], ..."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Shard:
    """Blocks in order of term and chunk number. terms: the distinct terms, in order; of block b, postings lie at
    at[b]:at[b + 1] of numbers (of chunks), items (numbers of items), tf and dl."""

    terms: list[str]
    first_block: np.ndarray
    first: np.ndarray
    last: np.ndarray
    bound: np.ndarray
    at: np.ndarray
    numbers: np.ndarray
    items: np.ndarray
    tf: np.ndarray
    dl: np.ndarray
    average: float
    dead: np.ndarray
    counts: dict[str, int] = field(default_factory=lambda: {"blocks": 0, "read": 0, "postings": 0, "postings_read": 0})

    def __post_init__(self) -> None:
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.score = np.zeros(int(self.numbers.max(initial=-1)) + 1)
        self.item_of = np.zeros(len(self.score), np.int64)
        self.best = np.zeros(int(self.items.max(initial=-1)) + 1)
        self.gone = np.zeros(len(self.best), bool)
        self.gone[self.dead[self.dead < len(self.gone)]] = True

    def _read(self, blocks: np.ndarray, idf: float) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers and gains of the living postings of blocks."""
        at = ranges(self.at[blocks], self.at[blocks + 1])
        self.counts["read"] += len(blocks)
        self.counts["postings_read"] += len(at)
        if self.dead.size:
            at = at[~self.gone[self.items[at]]]
        numbers = self.numbers[at]
        self.item_of[numbers] = self.items[at]
        return numbers, idf * gain(self.tf[at].astype(float), self.dl[at].astype(float), self.average)

    def lists(self, asked: list[tuple[str, float]]) -> list[tuple[np.ndarray, float]]:
        """Blocks and idf of the terms of a query (term, idf) that the shard has."""
        known = [(self.place[t], idf) for t, idf in asked if t in self.place]
        return [(np.arange(self.first_block[i], self.first_block[i + 1]), idf) for i, idf in known]

    def all(self, asked: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers, items and scores of all chunks that match."""
        self.score[:] = 0
        for blocks, idf in self.lists(asked):
            numbers, gains = self._read(blocks, idf)
            self.score[numbers] += gains
        found = np.flatnonzero(self.score)
        return found, self.item_of[found], np.round(self.score[found], PLACES)

    def top(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers, items and scores of chunks among which are the best ones of the k best items; ties to the
        smaller item are broken by the caller, so what equals the k-th best is kept."""
        lists = self.lists(asked)
        self.counts["blocks"] += sum(len(b) for b, _ in lists)
        self.counts["postings"] += sum(int(self.at[b[-1] + 1] - self.at[b[0]]) for b, _ in lists)
        bounds = [idf * self.bound[blocks] for blocks, idf in lists]
        order = sorted(range(len(lists)), key=lambda i: -bounds[i].max())
        rest = np.r_[np.cumsum([bounds[i].max() for i in reversed(order)])[::-1], 0.0] if order else np.zeros(1)
        self.score[:], self.best[:], floor, taken = 0, 0, -np.inf, 0
        for i in order:
            if rest[taken] < floor - SLACK:
                break
            blocks, idf = lists[i]
            able = bounds[i] + rest[taken + 1] >= floor - SLACK
            if not able.all():
                # blocks that can't carry a chunk by themselves matter where a chunk is already in question
                seen = np.flatnonzero(self.score > max(0.0, floor - rest[taken] - SLACK))
                able |= np.searchsorted(seen, self.last[blocks], "right") > np.searchsorted(seen, self.first[blocks])
            numbers, gains = self._read(blocks[able], idf)
            self.score[numbers] += gains
            floor = max(floor, self._floor(numbers, k))
            taken += 1
        left = np.flatnonzero(self.score > 0)
        for i in order[taken:]:
            blocks, idf = lists[i]
            left = left[self.score[left] >= floor - rest[taken] - SLACK]
            at = np.searchsorted(self.last[blocks], left)
            inside = at < len(blocks)
            inside[inside] &= self.first[blocks[at[inside]]] <= left[inside]
            reach = self.score[left] + rest[taken + 1]
            reach[inside] += bounds[i][at[inside]]
            wanted = reach >= floor - SLACK
            left, at, inside = left[wanted], at[wanted], inside[wanted]
            numbers, gains = self._read(blocks[np.unique(at[inside])], idf)
            place = np.searchsorted(left, numbers)
            met = place < len(left)
            met[met] = left[place[met]] == numbers[met]
            self.score[numbers[met]] += gains[met]
            floor = max(floor, self._floor(numbers[met], k))
            taken += 1
        left = left[self.score[left] >= floor - SLACK] if len(left) else left
        return left, self.item_of[left], np.round(self.score[left], PLACES)

    def _floor(self, numbers: np.ndarray, k: int) -> float:
        """The k-th best item by the scores so far."""
        np.maximum.at(self.best, self.item_of[numbers], self.score[numbers])
        return float(np.partition(self.best, len(self.best) - k)[len(self.best) - k]) if len(self.best) >= k else -np.inf
