"""Rolling captions as prose, row by row: a fold in order whose state is a bounded tail, carried over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import shared_end


def _clean(text):
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, most, clean, ...) in order: what each adds to the text of its key so far. Of that text as much is kept
    as the key's longest caption could repeat."""
    current, tail = None, ""
    for batch in batches:
        out = []
        for key, most, caption in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if current != (key,):
                current, tail = (key,), ""
            fresh = caption[shared_end(tail, caption) :].strip() if caption else ""
            if fresh:
                tail = (f"{tail} {fresh}" if tail else fresh)[-most:]
            out.append(fresh)
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(out, pa.string())], names=[batch.schema.names[0], *batch.schema.names[3:], "fresh"])


def _ordered(captions: DataFrame, key: str, order: list[str], text: str, of, extra: str) -> DataFrame:
    clean = captions.select(key, *order, _clean(F.col(text)).alias("clean"))
    longest = clean.groupBy(F.col(key).alias("_key")).agg(F.max(F.length("clean")).alias("most"))
    rows = clean.join(longest, F.col(key).eqNullSafe(F.col("_key"))).select(key, "most", "clean", *order)
    many = int(captions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{c}` {captions.schema[c].dataType.simpleString()}" for c in [key] + (order if extra.startswith("fresh") else []))
    return rows.repartition(many, key).sortWithinPartitions(key, *order, "clean").mapInArrow(of, f"{schema}, {extra}")


def deoverlapped(captions: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, order and fresh: what each caption adds, "" where it only repeats. An item may have any number of captions: no
    row and no list holds them all. Nulls and blanks add nothing; captions of equal order are taken by their text."""
    return _ordered(captions, key, order, text, _fresh, "fresh string")


def prose(captions: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key and text: the fresh parts joined by blanks, one row a key, as the result asks; a task holds one item's text."""
    kind = to_arrow_type(captions.schema[key].dataType)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in _fresh(batches):
            done = []
            for item, fresh in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if current is not None and current != (item,):
                    done.append((current[0], " ".join(parts)))
                    parts = []
                current = (item,)
                if fresh:
                    parts.append(fresh)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([t for _, t in done], pa.string())], names=[key, "text"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([" ".join(parts)], pa.string())], names=[key, "text"])

    return _ordered(captions, key, order, text, joined, "text string")
