"""Exact top-k inner-product search (operator 8) by multi-resolution segment statistics.

Vectors are turned once by an orthogonal matrix that a bounded sample of them gives, so that leading components vary most;
inner products stay as they are. At a resolution, the leading components are segments of their own and the rest is one
segment, of which a vector keeps the mean and the length of its deviations from it. By Cauchy-Schwarz the inner product of
two vectors is at most the sum, over segments, of n * mean * mean + deviation * deviation, which is the same as a lower
bound of their distance given their norms. Finer resolutions have more leading components and go on from the coarser one's
sums. Two passes over pairs of blocks:

1. Each query scores, exactly, the rows of each block that its coarsest bound likes best. The k-th best of all these
   scores, over all blocks, is the query's floor: no row under it can be among the k best.
2. Bounds prune against that floor, coarse to fine; each resolution looks at the pairs that the one before has left. Where
   more than DENSE of a block's pairs are left, the next components are multiplied for all of them in one matrix product,
   which is cheaper than to pick pairs; where no bound prunes, that comes to the plain inner products and a comparison.
   Only survivors are scored, in integers, and one by one.

On vectors without any structure (independent components of equal variance) no segment can prune, as deviations in random
directions look alike. Block.numbers counts the products that both passes take.

Rows are dealt by hash into blocks of bounded size, queries into query blocks; each pair of blocks is one task's work,
its result at most k rows for each query. Nothing is broadcast and nothing is collected.

Defined cases: null vectors, those with a null, NaN or infinite component and those with a null id take no part. Vectors
of different dimensions don't meet; empty ones meet with score 0. Scores are exact for all finite components: where 64
bits may not hold every sum they are computed in Python's integers, and a result that is no long raises. Ties go to the
smaller id. A row isn't its own candidate: rows with the query's id are left out. Rows that repeat an id and a vector as a
query give their list once; of an id with several vectors the best hits of all are ranked together. Repeated candidates
each count. Empty tables give no rows. Extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

#: Shares of the components that lead, coarse to fine; the share of pairs beyond which all of a block's are multiplied; rows
#: that the turn is fitted on, and the most components that it is fitted for.
LEADING, DENSE, SAMPLE, TURNED = (1 / 8, 1 / 4, 1 / 2), 0.1, 4096, 1024
#: Seeds of a block that are scored for each query, in times k; and how many it offers, in times k over all blocks.
SEEDS, OFFERED = 8, 4
#: Integers beyond this aren't all doubles.
EXACT = 2**53
HITS = "query_id long, vec_id long, score long"
LONGS = np.iinfo(np.int64)


def resolutions(d: int) -> list[int]:
    """How many components lead, coarse to fine."""
    return sorted({max(1, round(share * d)) for share in LEADING} - {d}) if d > 1 else []


def turn(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the directions in which the sample varies, greatest first."""
    scaled = sample / max(1.0, float(np.abs(sample).max(initial=0)))
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


def segment(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(n) * mean and deviation length of whole rows, so that a bound is a sum of plain products of both."""
    mean = x.mean(axis=1)
    return mean * np.sqrt(x.shape[1]), np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))


def integers(components: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles: as 64-bit integers where these hold all of them, else as Python's."""
    if not components.size or float(np.abs(components).max()) < 2**52:
        return np.floor(components * 1024).astype(np.int64)
    # 1024 * x only moves the exponent; from 2**53 on a double is an integer, and Python's product can't overflow
    whole = [int(v) * 1024 if abs(v) >= EXACT else int(np.floor(v * 1024)) for v in components.ravel()]
    return np.array(whole, object).reshape(components.shape)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, exact: in doubles or 64 bits where these hold every sum, else in Python's integers."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    most = q.shape[1] * int(np.abs(q).max()) * int(np.abs(x).max())
    if most < EXACT:
        return np.einsum("ij,ij->i", q.astype(float), x.astype(float)).astype(np.int64)
    if most < 2**63:
        return np.einsum("ij,ij->i", q, x)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q, x)] + [None], object)[:-1]


class Block:
    """Bounds and exact scores between some queries and some rows, both of finite doubles."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, turned: np.ndarray | None = None):
        order = np.argsort(vid, kind="stable")
        x = x[order]
        self.qid, self.vid = qid, vid[order]
        self.exact = integers(q), integers(x)
        # bounds are in units of 1024 and of a power of two, so that they never overflow
        scaled = []
        self.unit = 20
        for v in (q, x):
            high = int(np.frexp(np.abs(v).max(initial=1))[1])
            v = np.where(np.abs(v) < 2.0**52, np.floor(np.clip(v, -(2.0**52), 2.0**52) * 1024) / 1024, v)
            scaled.append(np.ldexp(v, -high))
            self.unit += high
        self.q, self.x = scaled
        self.slack = 1e-9 * np.linalg.norm(self.q, axis=1)[:, None] * np.linalg.norm(self.x, axis=1)[None, :]
        self.own = qid[:, None] == self.vid[None, :]

        if turned is not None:
            self.q, self.x = self.q @ turned, self.x @ turned
        self.leading, self.numbers = resolutions(self.q.shape[1]), 0

    def rest(self, m: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The segments of all components from m on, of queries and of rows."""
        return segment(self.q[:, m:]), segment(self.x[:, m:])

    def _dense(self, sums: np.ndarray, a: int, m: int) -> np.ndarray:
        """Bounds of all pairs at m leading components; sums, of those before a, are added to."""
        sums += self.q[:, a:m] @ self.x[:, a:m].T
        self.numbers += sums.size * (m - a)
        return np.where(self.own, -np.inf, self._with_rest(sums, m, slice(None), slice(None), True) + self.slack)

    def _with_rest(self, sums: np.ndarray, m: int, i, j, outer: bool) -> np.ndarray:
        if m == self.q.shape[1]:
            return sums
        self.numbers += 2 * sums.size
        return sum((u[i][:, None] * v[j][None, :] if outer else u[i] * v[j]) for u, v in zip(*self.rest(m))) + sums

    def bound(self, m: int) -> np.ndarray:
        """Bounds of all pairs at m leading components, each at least its score; minus infinity for a query's own rows."""
        return self._dense(np.zeros((len(self.qid), len(self.vid))), 0, m)

    def exactly(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the pairs (i, j), a bounded number at a time."""
        step = max(1, (1 << 21) // max(1, self.q.shape[1]))
        self.numbers += len(i) * self.q.shape[1]
        parts = [scores(self.exact[0][i[a : a + step]], self.exact[1][j[a : a + step]]) for a in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def seeds(self, k: int, offered: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the `offered` best scores among the SEEDS * k rows of the highest bounds."""
        bound = self.bound(self.leading[0] if self.leading else self.q.shape[1])
        most = min(SEEDS * k, len(self.vid))
        j = np.argpartition(-bound, most - 1, axis=1)[:, :most].ravel()
        i = np.repeat(np.arange(len(self.qid)), most)
        able = bound[i, j] > -np.inf
        i, j, score = self._best(i[able], j[able], offered)
        return self.qid[i], self.vid[j], np.array([min(max(int(s), LONGS.min), LONGS.max) for s in score], np.int64) if score.dtype == object else score

    def _best(self, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (i, j) the k best of each query, with their scores."""
        score = self.exactly(i, j)
        order = np.lexsort((self.vid[j], -score, i)) if score.dtype != object else np.array(sorted(range(len(i)), key=lambda p: (i[p], -score[p], self.vid[j[p]])), np.int64)
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, np.arange(len(self.qid)))[i] < k
        return i[best], j[best], score[best]

    def hits(self, floor: list[int | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The k best rows of each query that reach its floor; and the pairs that each resolution left, coarse to fine, the
        last being all components."""
        least = np.array([-np.inf if f is None else f / 2**self.unit for f in floor])
        least = least - 1e-12 * np.where(np.isinf(least), 0, np.abs(least))
        sums, counts, before, pairs = np.zeros(self.own.shape), [], 0, None
        for m in [*self.leading, self.q.shape[1]]:
            if pairs is None:
                left = self._dense(sums, before, m) >= least[:, None]
                counts.append(int(left.sum()))
                if counts[-1] <= DENSE * left.size or m == self.q.shape[1]:
                    pairs = np.nonzero(left & ~self.own)
                    part = sums[pairs]
            else:
                i, j = pairs
                step = max(1, (1 << 20) // max(1, m - before))
                part = part + np.concatenate([np.einsum("ij,ij->i", self.q[i[a : a + step], before:m], self.x[j[a : a + step], before:m]) for a in range(0, len(i), step)] or [np.empty(0)])
                self.numbers += len(i) * (m - before)
                kept = self._with_rest(part, m, i, j, False) + self.slack[i, j] >= least[i]
                pairs, part = (i[kept], j[kept]), part[kept]
                counts.append(int(kept.sum()))
            before = m
        i, j, score = self._best(*pairs, k)
        if score.dtype == object and any(not LONGS.min <= s <= LONGS.max for s in score):
            raise OverflowError("a score among the best is no 64-bit integer")
        return self.qid[i], self.vid[j], score.astype(np.int64), counts


def _frame(found) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found[:3])))


NOTHING = tuple(np.empty(0, np.int64) for _ in range(3))


def _turns(dealt: DataFrame) -> dict[int, np.ndarray]:
    """A matrix for each dimension of which SAMPLE rows, the least by hash, hold enough; others stay as they are."""
    by_dimension: dict[int, list] = {}
    for r in dealt.where(F.col("d").between(2, TURNED)).orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("d", "v").collect():
        by_dimension.setdefault(r["d"], []).append(r["v"])
    return {d: turn(np.array(v, float)) for d, v in by_dimension.items() if len(v) >= d}


def exact_top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, rows_per_block: int = 4096, queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    dealt = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    finite = "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    dealt = dealt.where(finite).withColumn("d", F.size("v"))
    n = dealt.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_every == 0).alias("q")).first()
    blocks = max(partitions(spark), -(-n["n"] // rows_per_block))
    query_blocks = max(1, -(-n["q"] // queries_per_block))
    turns = _turns(dealt)
    rows = dealt.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = dealt.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"]).withColumn("qb", F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(query_blocks)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = ["d", "qb", "b"]

    def block(left: pd.DataFrame, right: pd.DataFrame) -> Block | None:
        if not len(left) or not len(right):
            return None
        return Block(left["vec_id"].to_numpy(np.int64), np.stack(left["v"]).astype(float), right["vec_id"].to_numpy(np.int64), np.stack(right["v"]).astype(float), turns.get(len(left["v"].iloc[0])))

    offered = min(k, max(1, -(-OFFERED * k // blocks)))

    def seed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        met = block(left, right)
        return _frame(met.seeds(k, offered) if met else NOTHING)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        met = block(left, right)
        return _frame(met.hits([None if pd.isna(f) else int(f) for f in left["floor"]], k) if met else NOTHING)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    seeds = asked.withColumn("b", everywhere).groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(seed, HITS)
    # as text, so that no 64-bit floor is rounded on its way through pandas
    floors = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("string").alias("floor"))
    asked = materialise(asked.join(floors, "vec_id", "left"), "queries")
    near = asked.withColumn("b", everywhere).groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(meet, HITS)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
