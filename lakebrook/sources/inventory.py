"""What files there are, by their metadata alone: a listing as a DataFrame, of which no file is opened."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str, excluded: Collection[str] = ()) -> DataFrame:
    """path, folder (below root, "" for root itself), name, suffix (lower case, with its dot, "" without one), length and
    modified_at of every file below root, but for those that lie in a folder of an excluded name at any depth. Spark's file
    source lists and prunes: the files' content isn't among the columns that are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified_at"))
    plain = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.substr(plain, F.lit(len(base) + 2))
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    placed = files.withColumns({"folder": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), "name": name, "suffix": F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))})
    inside = F.arrays_overlap(F.split("folder", "/"), F.array(*map(F.lit, excluded)).cast("array<string>"))
    return placed.where(~inside).select("path", "folder", "name", "suffix", "length", "modified_at")


def by_suffix(files: DataFrame) -> DataFrame:
    """suffix, files, bytes, folders, newest of an inventory."""
    return files.groupBy("suffix").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.countDistinct("folder").alias("folders"), F.max("modified_at").alias("newest"))
