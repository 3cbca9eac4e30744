"""The hand-edited source manifest: a Markdown table of six columns, checked before use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The header, and the host that a platform's URLs must be on.
HEADER = ("platform", "handle", "name", "url", "type", "notes")
HOSTS = {"youtube": "youtube.com", "x": "x.com"}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where("not forall(c, x -> x rlike '^:?-+:?$')")
    return rows.where(F.transform("c", lambda x: F.lower(x)) != F.array(*[F.lit(h) for h in HEADER])).select("c", *[F.get("c", F.lit(i)).alias(h) for i, h in enumerate(HEADER)])


def problems(manifest: DataFrame) -> DataFrame:
    """platform, handle, problem: wrong column counts, repeated handles or URLs within a platform, URLs off the platform."""
    rows = manifest.withColumn("platform", F.lower("platform"))
    out = rows.where(F.size("c") != len(HEADER)).select("platform", "handle", F.lit("COLUMN_COUNT").alias("problem"))
    for column, name in (("handle", "REPEATED_HANDLE"), ("url", "REPEATED_URL")):
        twice = rows.groupBy("platform", column).agg(F.count("*").alias("n"), F.min("handle").alias("h")).where("n > 1")
        out = out.unionByName(twice.select("platform", F.col("h").alias("handle"), F.lit(name).alias("problem")))
    host = F.coalesce(*[F.when(F.col("platform") == k, F.lit(v)) for k, v in HOSTS.items()])
    on_it = F.col("url").startswith("https://") & (F.regexp_extract("url", r"^https://(?:www\.)?([^/?#]+)", 1) == host)
    return out.unionByName(rows.where(~F.coalesce(on_it, F.lit(False))).select("platform", "handle", F.lit("WRONG_URL").alias("problem")))


def of_platform(manifest: DataFrame, platform: str) -> DataFrame:
    return manifest.where(F.lower("platform") == platform.lower())


def unsupported(manifest: DataFrame, supported: Sequence[str]) -> DataFrame:
    """Sources that a runner of these platforms can't process, those without a platform included."""
    return manifest.where(~F.coalesce(F.lower("platform").isin(*[p.lower() for p in supported]), F.lit(False)))
