"""The reference's entities over the test tables: as DataFrames, and as SQL for the oracles.

documents stand for evidence (published at the event of the same number), their lines for chunks, benchmark texts for
queries, lineitem for attempts (an order is a task, a line a round), orders for tasks and registry rows, labels for two
raters, events for the run log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import chunks_by_line
from ..operators.scan import Scan
from ..operators.store import IndexStore
from ..session import shared_folder

_stored: dict[tuple[str, str], IndexStore] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("platform"), F.col("source").alias("source_key"), "text")
    events = table(spark, d, "events").select(F.col("event_id").alias("evidence_id"), F.col("ts").alias("published_at"))
    return docs.join(events, "evidence_id", "left")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_by_line(table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), "text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def scan(spark: SparkSession, d: str, analyzer: str = "plain") -> Scan:
    """The questions against the documents as they are read, without an index."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), "text")
    return Scan(items, questions(spark, d), analyzer)


def stored_index(spark: SparkSession, d: str) -> IndexStore:
    """The documents' index in the shared folder, built once for an application and path, deleted when it ends. Questions
    of the registered queries are answered from it; its words are kept as they stand, as SQL can check them, and as stems."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        store = IndexStore(spark, path, ("plain", "stem"))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        store.refresh(table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), "text"))
        _stored[key] = store
    return _stored[key]


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("round"), F.col("l_suppkey").alias("provider"),
        F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("output_tokens"), (F.col("l_extendedprice") / 1000).alias("latency_seconds"),
        F.col("l_discount").alias("cost_usd"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ended_at"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("outcome"),
        F.col("o_orderpriority").alias("case_id"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("cost"),
    )


SQL = {
    "evidence": "evidence AS (SELECT doc_id AS evidence_id, lang AS platform, source AS source_key, text, ts AS published_at FROM documents LEFT JOIN events ON event_id = doc_id)",
    "chunks": "chunks AS (SELECT evidence_id, chunk_index, trim(piece) AS text FROM (SELECT doc_id AS evidence_id, unnest(range(len(string_split(text, chr(10))))) AS chunk_index, unnest(string_split(text, chr(10))) AS piece FROM documents) WHERE trim(piece) <> '')",
    "questions": "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "attempts": "attempts AS (SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS round, l_suppkey AS provider, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS output_tokens, l_extendedprice / 1000 AS latency_seconds, l_discount AS cost_usd, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ended_at FROM lineitem)",
    "tasks": "tasks AS (SELECT o_orderkey AS task_id, o_custkey AS source_id, o_orderstatus AS outcome, o_orderpriority AS case_id, o_orderdate AS published_at, o_totalprice AS cost FROM orders)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


class Registry:
    """Collects queries and their SQL: @registry("key", sql) over a function of (spark, sf_dir)."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add
