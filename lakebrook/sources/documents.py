"""JSON documents: suites of cases, frozen windows and reports. Small ones are written as one file, named after what they hold."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import put_file, rename
from ..operators.index import fingerprint

SNAPSHOT_VERSION = 1
CASES = (
    "cases array<struct<case_id: string, question: string, expected_outcome: string, "
    "evidence: array<struct<evidence_id: string, canonical_url: string, snippet: string>>, required_citation_ids: array<string>, forbidden_citation_ids: array<string>>>"
)


class Unsupported(ValueError):
    """A document of another kind or version than this engine reads."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, value: dict, replace: bool = True) -> None:
    """One JSON file, which is there whole, or as it was before: the new one takes its place in one step. Without replace
    an existing one is an error."""
    target, fs = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n").encode()))
    finally:
        out.close()
    if replace:
        rename(spark, part, target, True)
    elif not put_file(spark, part, target):
        raise FileExistsError(path)


def read_document(spark: SparkSession, path: str) -> dict:
    raw = spark.read.text(path, wholetext=True).first()
    value = json.loads(raw["value"]) if raw else None
    if not isinstance(value, dict):
        raise Unsupported(f"{path} holds no JSON object")
    return value


def read_cases(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The cases of suites {"cases": [...]}, with the file and place that each stands in. Several paths and globs may name
    one file: its cases come once."""
    rows = spark.read.schema(CASES).option("multiLine", "true").json(paths if isinstance(paths, str) else list(dict.fromkeys(paths)))
    return rows.select(F.col("_metadata.file_path").alias("path"), "cases").dropDuplicates(["path"]).select("path", F.posexplode("cases").alias("place", "c")).select("path", "place", "c.*")


def read_reports(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """One row for each report file; a file that two patterns match is read once."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(list(dict.fromkeys(paths)))
    return rows.withColumn("path", F.col("_metadata.file_path")).dropDuplicates(["path"])


def snapshot_name(since: datetime, until: datetime, platforms: Sequence[str] = ()) -> str:
    """Two windows never share a name: 2026-01-01-to-2026-01-08-x-youtube."""
    scope = "-".join(sorted({p.strip().lower() for p in platforms if p.strip()})) or "all"
    return f"{since.date()}-to-{until.date()}-{''.join(c if c.isalnum() and c.isascii() else '-' for c in scope)}"


def freeze_window(items: DataFrame, path: str, since: datetime, until: datetime, counters: dict, platforms: Sequence[str] = ()) -> dict:
    """Writes a window's items (evidence_id, content_hash and any others) as Parquet beside a description of the window, last, so that
    a snapshot without one is none. The description carries the items' fingerprint: a run that resumes sees whether
    another set would be meant. Items are not gathered, however many there are. A window that is frozen stays as it is: to
    freeze it again is an error, and what a failed attempt has left is named by no description."""
    spark, name = items.sparkSession, f"items-{uuid.uuid4().hex}"
    described, fs = _fs(spark, f"{path}/window.json")
    if fs.exists(described):
        raise FileExistsError(f"{path} is frozen")
    items.write.parquet(f"{path}/{name}")
    told = fingerprint(spark.read.parquet(f"{path}/{name}")).first()
    snapshot = {
        "snapshot_version": SNAPSHOT_VERSION, "since": since.isoformat(), "until": until.isoformat(), "platforms": sorted(platforms),
        **counters, "n_items": told["n"], "index_signature": told["fingerprint"], "items": name,
    }
    write_document(spark, f"{path}/window.json", snapshot, replace=False)
    return snapshot


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(description, items); an unknown version, or items other than those described, are refused."""
    snapshot = read_document(spark, f"{path}/window.json")
    if snapshot.get("snapshot_version") != SNAPSHOT_VERSION:
        raise Unsupported(f"{path} is no window snapshot of version {SNAPSHOT_VERSION}")
    items = spark.read.parquet(f"{path}/{snapshot['items']}")
    if fingerprint(items).first()["fingerprint"] != snapshot["index_signature"]:
        raise Unsupported(f"the items of {path} are not those that were frozen")
    return snapshot, items
