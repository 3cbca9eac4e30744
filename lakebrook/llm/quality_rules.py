"""Quality rules (operator 4): exact rule counts, then an isolation forest on rule statistics.

The base rules are exact counts over the whole text. The verdict for texts that they let pass comes from an isolation
forest: random splits of rule statistics isolate anomalous rows on short paths. Each tree grows on SUBSAMPLE of the labelled
rows of quality 1, drawn by a hash, which is what an isolation forest is; the means that statistics are drawn to, and the
thresholds, come from all of these rows. A text is rejected when its score passes, for any kind of rule, the threshold at
which FALSE_REJECTS of the labelled good rows that grew no tree would go, counted exactly in BINS bins of scores.

Defined cases: null and empty texts have zero counts and fail the base rules. Repeated rows are judged alike and all kept.
An empty table gives no rows; without labels nothing but the base rules rejects. Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, returning, table
from .text_statistics import COUNTS, FEATURES, statistics
from .training import good_features

TREES, SUBSAMPLE = 64, 256
FALSE_REJECTS = 0.002
MARGIN = 0.01
#: Bins of scores, which lie between 0 and 1: a threshold is its bin's upper end.
BINS = 1 << 14
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

#: Rules by kind; each kind has a forest and a threshold of its own, so that one odd statistic isn't lost among ordinary
#: ones. The length of a text is no statistic, nor is what differs between languages.
KINDS = {
    "marks": ("symbols_a_word", "pipe_share"),
    "shouting": ("upper_share", "bang_share", "capital_word_share"),
    "repetition": ("repeat_share", "top_word_share", "adjacent_same_share"),
    "shape": ("word_length", "long_word_share", "single_char_share"),
}
#: Statistics of short texts scatter: they are drawn to the mean of good rows as if this many ordinary words stood by.
PRIOR_WORDS = 40
#: How far beyond the rows' range a random split may fall, in ranges, so that values out there end on short paths.
REACH = 1.0


@dataclass(frozen=True)
class Forest:
    columns: tuple[int, ...]
    middle: np.ndarray
    feature: np.ndarray  # trees x nodes; -1 for a leaf
    split: np.ndarray
    path: np.ndarray  # path length at the node, with what an unsplit leaf would add
    depth: int
    normal: float
    threshold: float = 1.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / normal path): near 1 anomalous, under 0.5 ordinary. Children of node i are 2i+1 and 2i+2."""
        x = drawn(features, self.columns, self.middle)
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[row, np.maximum(f, 0)] >= split[at]))
            total += path[at]
        return 2.0 ** (-total / (len(self.path) * self.normal))


def drawn(features: np.ndarray, columns: tuple[int, ...], middle: np.ndarray) -> np.ndarray:
    words = np.expm1(features[:, :1])
    return middle + (features[:, columns] - middle) * words / (words + PRIOR_WORDS)


def _unsuccessful(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, x)]
    while todo:
        i, level, rows = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        able = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(able):
            path[i] = level + _unsuccessful(len(rows))
            continue
        f = int(rng.choice(able))
        span = high[f] - low[f]
        at = rng.uniform(low[f] - REACH * span, high[f] + REACH * span)
        feature[i], split[i] = f, at
        right = rows[:, f] >= at
        for child, part in ((2 * i + 1, rows[~right]), (2 * i + 2, rows[right])):
            if len(part):
                todo.append((child, level + 1, part))
            else:
                path[child] = level + 1
    return feature, split, path


def grown(rows: np.ndarray, means: np.ndarray, rng: np.random.Generator) -> list[Forest]:
    """A forest for each kind of rule, its threshold still open; each tree on rows of its own where there are enough."""
    size = min(SUBSAMPLE, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    forests = []
    for names in KINDS.values():
        columns = tuple(FEATURES.index(n) for n in names)
        middle = means[list(columns)]
        x = drawn(rows, columns, middle)
        own = len(x) >= TREES * size
        trees = [_tree(x[t::TREES] if own else x[rng.choice(len(x), size, replace=False)], depth, rng) for t in range(TREES)]
        forests.append(Forest(columns, middle, *(np.stack([t[i] for t in trees]) for i in range(3)), depth, max(1e-9, _unsuccessful(size))))
    return forests


def _rank(n: int) -> int:
    """The place, from 0, of the score that all but FALSE_REJECTS of n stay under."""
    return min(n - 1, int(np.floor(n * (1 - FALSE_REJECTS))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 4) -> list[Forest]:
    """A forest of the good rows for each kind of rule, each with its threshold; none without good rows."""
    good = x[y == 1]
    if len(good) < 2:
        return []
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(good))
    grow, hold = good[order[::2]], good[order[1::2]]
    # calibrated on good rows that grew no tree
    return [replace(f, threshold=float(np.sort(f.scores(hold))[_rank(len(hold))]) + MARGIN) for f in grown(grow, grow.mean(axis=0), rng)]


def fitted(documents: DataFrame, labels: DataFrame, seed: int = 4) -> list[Forest]:
    """The forests of all labelled good rows. Their means and the thresholds' counts are aggregates over every row; what
    reaches the driver are the trees' own rows, TREES * SUBSAMPLE at most and half of all at most, and BINS counts a kind."""
    rows = materialise(good_features(documents, labels).select("f", F.xxhash64("doc_id", F.lit(seed)).alias("hash")), "features")
    means = rows.agg(F.count("*"), *[F.round(F.avg(F.element_at("f", i + 1)), 9) for i in range(len(FEATURES))]).first()
    if means[0] < 2:
        return []
    drawing = rows.where("pmod(hash, 2) = 0").orderBy("hash", "f").limit(TREES * SUBSAMPLE).collect()
    last = drawing[-1]["hash"] if drawing else -(2**63)
    hold = rows.where((F.col("hash") > F.lit(last)) | (F.pmod("hash", F.lit(2)) != 0))
    if not drawing or not hold.take(1):  # a handful of rows, all on one side
        every = np.array([r["f"] for r in rows.orderBy("hash", "f").limit(TREES * SUBSAMPLE).collect()])
        return fit(every, np.ones(len(every), np.int64), seed)
    forests = grown(np.array([r["f"] for r in drawing]), np.array(means[1:], float), np.random.default_rng(seed))

    def place(batches):
        for b in batches:
            f = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(FEATURES))
            for kind, forest in enumerate(forests):
                bins = np.floor(forest.scores(f) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), kind, np.int32)), pa.array(bins)], ["kind", "bin"])

    counted = hold.select("f").mapInArrow(returning(place), "kind int, bin long").groupBy("kind", "bin").agg(F.count("*").alias("n")).toPandas()
    out = []
    for kind, forest in enumerate(forests):
        mine = counted[counted["kind"] == kind].sort_values("bin")
        upto = mine["n"].cumsum().to_numpy()
        top = mine["bin"].to_numpy()[np.searchsorted(upto, _rank(int(upto[-1])), "right")]
        out.append(replace(forest, threshold=float(top + 1) / BINS + MARGIN))
    return out


def verdicts(texts: pa.Array, forests: list[Forest]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept, and how far each text's worst score is beyond that kind's threshold."""
    counts, features = statistics(texts)
    n, rep = counts[:, 0], counts[:, 4]
    failed = (n < 20) | (100 * rep > 30 * n)
    score = np.max([f.scores(features) - f.threshold for f in forests], axis=0) if forests else np.full(len(n), -1.0)
    return counts, failed, ~failed & (score <= 0), score


def judge(documents: DataFrame, forests: list[Forest]) -> DataFrame:
    """One row per document: its counts, base_failed, kept, and the score behind it."""

    def run(batches):
        for b in batches:
            counts, failed, kept, score = verdicts(b.column("text"), forests)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(failed), pa.array(kept), pa.array(score)], SCHEMA_NAMES)

    return documents.select("doc_id", "text").mapInArrow(returning(run), SCHEMA)


def keep(documents: DataFrame, forests: list[Forest]) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdicts(b.column(at), forests)[2]))

    return documents.mapInArrow(returning(run), documents.schema)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fitted(documents, table(spark, sf_dir, "labels")))
