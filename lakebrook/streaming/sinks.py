"""Sinks that are right after a retry: a batch that is delivered again changes nothing.

Rows that are only added go to Spark's own file sink, which keeps a log of its batches. Rows that replace others by key go
through merged(): each batch is one version of a StateTable, put into its commit log together with the query's id and the
batch's number, so that the rows and the fact that they were taken become visible in one step. A driver that dies before
that leaves files that no version names; one that dies after it finds, on restart, that the version holds the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commits import StateTable


def merged(table: StateTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. The query's id comes from its checkpoint and stays the same over restarts."""

    def each(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if table.holds((query, number)):
            # computed all the same: the batch's states are committed by the tasks that make its rows
            rows.write.format("noop").mode("overwrite").save()
        else:
            table.upsert(rows, (query, number))

    return each


def once(events: DataFrame, time: str, key: str, delay: str) -> DataFrame:
    """Events without those that were delivered before, and those later than the watermark; what is remembered of a key
    goes when the watermark passes it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def closed_windows(events: DataFrame, time: str, keys: list[str], window: str) -> DataFrame:
    """n of events (that have a watermark) by keys and window of time, as soon as the watermark has closed the window."""
    return events.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start_at"), "n")


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> StreamingQuery:
    """Takes what has arrived since the checkpoint and ends: to each, or to Parquet files at path."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()
    return query
