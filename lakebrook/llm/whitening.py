"""Embedding whitening (operator 11) by merged covariances.

Entries become the integers floor(256 * c), and each different vector counts once. Every partition folds its vectors into
their count n, their exact sums S and the scatter of what is left when the partition's mean is taken away; two such states
merge by Chan's pairwise formula, scatter + scatter + (difference of means, outer product) * n * m / (n + m), in a
treeReduce whose depth grows with the partitions, so that the driver meets a few states only. The driver takes the
eigenvectors of the covariance; a second pass over the vectors merges the covariance of what they are whitened to, in the
same way, and compares it with the identity.

Means are never rounded: n * x - S is an integer, and S_a * n_b - S_b * n_a is one too; only their quotients are doubles.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; those with a null id stay, and
rows that repeat are returned as often as they come, while equal vectors are fitted once. Entries of which floor(256 * c)
is no 64-bit integer raise. Vectors of different dimensions are whitened apart, each dimension with its own n, components
and error; the driver holds one covariance for each dimension there is. A component without variance (fewer different
vectors than components, constant entries) has explained 0 and whitened null and takes no part in the error; explained is
null where there is no variance at all. Vectors without entries have no components and give no rows, as do empty tables.
The sign of a component is such that its entry of greatest size is positive. deviation is a decimal; in the query it is a
long, null where a long can't hold it. Extra columns are passed over.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, returning, table

SCALE = 256
COMPONENTS = 4
#: States that one step of the treeReduce merges; entries that are taken at once; a component below this share of the largest has no variance.
FAN_IN, ENTRIES, NO_VARIANCE = 16, 1 << 18, 1e-12
LONG = 2**63


class State(NamedTuple):
    """n vectors, their sums (of integers: exact ones), and the scatter about their mean."""

    n: int
    sums: list
    scatter: np.ndarray

    def merge(self, other: State) -> State:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums)])
        return State(n + m, [a + b for a, b in zip(self.sums, other.sums)], self.scatter + other.scatter + np.outer(apart, apart) * (n * m / (n + m)))


class Fit(NamedTuple):
    n: int
    sums: list[int]
    vectors: np.ndarray  # one row a component
    values: np.ndarray
    trace: float


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where these hold it, else as Python's."""
    most = max([abs(s) for s in sums], default=0)
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + most < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def state_of(x: np.ndarray) -> State:
    if len(x) * max(abs(int(x.max())), abs(int(x.min()))) < LONG:
        sums = [int(s) for s in x.sum(axis=0)]
    else:
        sums = [int(s) for s in x.astype(object).sum(axis=0)]
    away = (centred(x, len(x), sums) / len(x)).astype(float)
    return State(len(x), sums, away.T @ away)


def merged(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    return a | {d: a[d].merge(s) if d in a else s for d, s in b.items()}


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of a list column, one dimension and about
    ENTRIES entries at a time; vectors without entries are left out."""
    step = max(1, ENTRIES * len(column) // max(1, len(column.flatten())))
    for first in range(0, len(column), step):
        part = column.slice(first, step)
        sizes = part.value_lengths().to_numpy(zero_copy_only=False)
        starts, values = np.cumsum(sizes) - sizes, part.flatten().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == d)
            yield first + rows, values[starts[rows][:, None] + np.arange(d)]


def fold(spark_rows: DataFrame, of) -> dict[int, State]:
    """The merged states of all partitions of spark_rows (x), by dimension; of gives the state of some vectors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for batch in batches:
            for _, x in _by_dimension(batch.column(0)):
                states = merged(states, {x.shape[1]: of(x)})
        if states:
            columns = [[d for d in states], [s.n for s in states.values()], [[repr(v) for v in s.sums] for s in states.values()], [s.scatter.ravel() for s in states.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64())))], names=["d", "n", "sums", "scatter"])

    found = spark_rows.mapInArrow(returning(local), "d long, n long, sums array<string>, scatter array<double>").rdd
    many = found.getNumPartitions()
    if not many:
        return {}

    def state(row) -> dict[int, State]:
        sums = [float(s) if "." in s or "e" in s else int(s) for s in row.sums]
        return {row.d: State(row.n, sums, np.array(row.scatter).reshape(len(sums), len(sums)))}

    depth = max(2, math.ceil(math.log(many, FAN_IN)))
    return found.map(state).treeAggregate({}, merged, merged, depth)


def solve(state: State, components: int) -> Fit:
    """Unit eigenvectors by falling eigenvalue."""
    cov = state.scatter / state.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    values = np.where(values[order] > NO_VARIANCE * max(float(values.max()), 0.0), values[order], 0.0)
    return Fit(state.n, state.sums, vectors * signs[:, None], values, float(np.trace(cov)))


def project(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened vectors; NaN for components without variance."""
    away = centred(x, fit.n, fit.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        return away, (away / fit.n).astype(float) @ fit.vectors.T / np.where(fit.values > 0, np.sqrt(fit.values), np.nan)


def _squares(away: np.ndarray) -> pa.Array:
    """Exact sums of squares as decimals, null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    if away.dtype != object and away.shape[1] * max(abs(int(away.max(initial=0))), abs(int(away.min(initial=0)))) ** 2 < LONG:
        # 19 digits at first: a long has no more
        return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(kind)
    whole = (away.astype(object) ** 2).sum(axis=1)
    return pa.array([decimal.Decimal(int(v)) if v < 10**38 else None for v in whole], kind)


def _whitened_state(fits: dict[int, Fit]):
    """A function that gives the state of the whitened vectors, without components that have no variance."""

    def of(x: np.ndarray) -> State:
        fit = fits[x.shape[1]]
        w = project(x, fit)[1][:, fit.values > 0]
        sums = w.sum(axis=0)
        away = w - sums / len(w)
        return State(len(w), sums.tolist(), away.T @ away)

    return of


def identity_error(state: State) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, in size."""
    cov = state.scatter / state.n
    return float(np.abs(cov - np.eye(len(cov))).max(initial=0))


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of embeddings (vec_id, embedding), without the vectors that take no part."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    holds = F.forall("c", lambda v: (v >= -LONG / SCALE) & (v < LONG / SCALE))
    x = F.transform("c", lambda v: F.floor(v * SCALE))
    checked = F.when(holds, x).otherwise(F.raise_error(F.lit("an entry times 256 is no 64-bit integer")).cast("array<long>"))
    return embeddings.select("vec_id", c.alias("c")).where(finite).select("vec_id", checked.alias("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of embeddings (vec_id, embedding)."""
    rows = integers(embeddings)
    different = materialise(rows.select("x").distinct(), "vectors")
    fits = {d: solve(state, components) for d, state in fold(different, state_of).items()}
    errors = {d: identity_error(state) for d, state in fold(different, _whitened_state(fits)).items()}
    discard(different)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_dimension(batch.column(1)):
                fit, error = fits[x.shape[1]], errors[x.shape[1]]
                away, w = project(x, fit)
                squares, k = _squares(away), len(fit.values)
                each = pa.array(np.repeat(np.arange(len(at)), k))
                flat = w.ravel()
                explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(flat), fit.n)),
                        squares.take(each), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(at)), mask=np.isnan(np.tile(explained, len(at)))), pa.array(np.full(len(flat), error)),
                    ],
                    names=names,
                )

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(out, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def query(spark, sf_dir):
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))
