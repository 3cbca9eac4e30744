"""Structured Streaming over the append-only run log, and incremental refresh of upserted tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON as they are appended; malformed ones are null rows, which are dropped."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null").select("e.*")


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], window: str, lateness: str) -> DataFrame:
    """n by event-time window and keys. Later than the watermark is too late; the time is cast, as NTZ can't have one."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start_at"), "n")


def reconciled_counts(events: DataFrame) -> DataFrame:
    """The batch twin of windowed_counts, for windows that are still open."""
    rows = events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start_at"), "n")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Hands what has arrived since the checkpoint to `each`, batch by batch, and ends."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
