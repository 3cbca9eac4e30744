"""Features of labelled rows, for the models that are fitted on them: of all, or of a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning
from .text_statistics import FEATURES, statistics

#: crc32(doc_id as text) mod 5 == 0 marks the rows held out from every fit.
FOLDS = 5


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the rows that aren't held out."""
    return labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "quality")


def good_features(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, f (features) of every labelled row of quality 1 that isn't held out; of rows that repeat an id, the least.
    Texts are measured where they lie: the features, a tenth of their size, go to the labels."""
    good = labelled(labels).where("quality = 1").select("doc_id").distinct()
    found = _measured(documents.where("doc_id is not null").where(~held_out()).withColumn("quality", F.lit(1)))
    return found.join(good.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("f").alias("f"))


def _measured(rows: DataFrame) -> DataFrame:
    """doc_id, quality, f of rows (doc_id, quality, text) that have a text."""

    def measure(batches):
        for b in batches:
            _, f = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "quality", "f"])

    return rows.where("text is not null").select("doc_id", "quality", "text").mapInArrow(returning(measure), "doc_id long, quality int, f array<double>")


def labelled_features(documents: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality labels of at most `most` labelled rows that aren't held out, the first by a hash of their id.

    The sample's size is bounded by `most`, so that its ids are broadcast and its features collected; the texts are scored
    where they lie. Rows without a 0/1 quality, an id or a text are left out; of rows that repeat an id, the one with the
    least features counts, so that the bound holds.
    """
    sample = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    measured = _measured(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    found = measured.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).toPandas()
    if not len(found):
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)
    x, y = np.stack(found["f"].to_numpy()), found["quality"].to_numpy()
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order in which tasks end
    return x[order], y[order]
