"""Pluggable evidence adapters as a Python data source: spark.read.format("evidence").option("adapter", "module:name")."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "platform string, source_key string, content_id string, canonical_url string, published_at string, title string, author string, "
    "kind string, text string, locator string, artifact_path string, extraction_status string"
)


class EvidenceSource(DataSource):
    """An adapter is a callable of options: partitions() gives work items, collect(item) yields records as tuples."""

    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "EvidenceReader":
        return EvidenceReader(dict(self.options))


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _adapter(self):
        module, _, name = self.options["adapter"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(item) for item in self._adapter().partitions()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._adapter().collect(partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EvidenceSource)
