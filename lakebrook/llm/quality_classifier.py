"""Quality classifier (operator 5): a generalised additive model with pairwise interactions.

Cyclic boosting: in turn each feature gets a shallow tree (two splits of its bins, by gradient and curvature of the
logistic loss), whose steps add up in one lookup table for each feature; then the pairs with the most left to explain get
tables of their own, from depth-two trees over both features' bins. A score is the sum of looked-up values through the
logistic function: binning and additions on whole columns.

It is fitted on at most FIT_ROWS labelled rows, none of them held out; labels, lang, source and doc_id are no inputs.
Defined cases: null and empty texts are scored as empty texts. Repeated rows score alike and are all kept. An empty table
gives no rows. With labels of one kind or none at all the score is the smoothed share of label 1 for every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning, table
from .text_statistics import statistics
from .training import held_out, labelled_features

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, RATE, SMOOTH = 60, 0.15, 5.0
THRESHOLD = 0.3


@dataclass
class Additive:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # features, their coarse cuts, table

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            z += values[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, a, b, values in self.pairs:
            z += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Cuts half-way between values, at quantiles of the distinct values and of the rows."""
    d = np.unique(v)
    if len(d) < 2:
        return np.empty(0)
    q = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(d, np.linspace(0, 1, bins // 2 + 1)[1:-1])]))
    return np.unique((q + d[np.minimum(np.searchsorted(d, q, "right"), len(d) - 1)]) / 2)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + SMOOTH)


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps over bins of the best tree of two splits (three leaves)."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gain = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that splits one feature and then each side by the other."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(a)):
            total, steps = 0.0, np.zeros_like(a)
            for rows in (slice(0, k), slice(k, len(a))):
                u, v = a[rows].sum(axis=0), b[rows].sum(axis=0)
                left, lh = np.cumsum(u)[:-1], np.cumsum(v)[:-1]
                gain = _gain(left, lh) + _gain(u.sum() - left, v.sum() - lh)
                c = int(np.argmax(gain)) + 1
                total += gain[c - 1]
                steps[rows, :c] = _leaf(u[:c].sum(), v[:c].sum())
                steps[rows, c:] = _leaf(u[c:].sum(), v[c:].sum())
            if total > best:
                best, out = total, steps.T if turn else steps
    return best - float(_gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))), [], [], [])
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    z = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(d):
            if not len(model.cuts[j]):
                continue
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _shallow(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n))
            model.tables[j] += step
            z += step[binned[j]]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    small = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(i, j, v):
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(small[i] * b + small[j], v, a * b).reshape(a, b)

    g, h = slopes()
    able = [(i, j) for i in range(d) for j in range(i + 1, d) if len(coarse[i]) and len(coarse[j])]
    ranked = sorted(((_square(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in able), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in ranked}
    for _ in range(ROUNDS // 3):
        for i, j in tables:
            g, h = slopes()
            step = RATE * _square(grid(i, j, g), grid(i, j, h))[1]
            tables[i, j] += step
            z += step[small[i], small[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in tables.items()]
    return model


def fitted(documents: DataFrame, labels: DataFrame) -> Additive:
    return fit(*labelled_features(documents, labels, FIT_ROWS))


def score(documents: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for b in batches:
            s = model.score(statistics(b.column("text"))[1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(returning(run), "doc_id long, held_out boolean, score double, predicted int")


def keep(documents: DataFrame, model: Additive) -> DataFrame:
    """The rows of documents that are predicted as quality 1, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(at))[1]) >= THRESHOLD))

    return documents.mapInArrow(returning(run), documents.schema)


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, fitted(documents, table(spark, sf_dir, "labels")))
