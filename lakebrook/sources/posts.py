"""Posts with attachments: JSON files of one post each, media by key, the best variant, documents without text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "id string, created_at string, text string, author_id string, attachments struct<media_keys: array<string>>"
DOCUMENT_SUFFIXES = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts with their folder; a post without an id has what follows the first underscore of its folder's name."""
    posts = spark.read.schema(POST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "post.json").json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/post\.json$", 1)
    return posts.select("*", folder.alias("folder")).withColumn("id", F.coalesce("id", F.regexp_extract("folder", r"^[^_]*_(.+)$", 1)))


def unextracted(spark: SparkSession, path: str) -> DataFrame:
    """path, warning of attached documents that no text was taken from. File names only, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*DOCUMENT_SUFFIXES)).withColumn("warning", F.lit("UNEXTRACTED_DOCUMENT"))


def merge_pages(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Items of paged listings, the last page's version of each."""
    return pages.groupBy(key).agg(F.max_by(F.struct(*[c for c in pages.columns if c != key]), F.col(page)).alias("v")).select(key, "v.*")


def best_variants(media: DataFrame) -> DataFrame:
    """media_key, url of media (media_key, variants array of url, bit_rate): the highest bit rate, the first on a tie."""
    each = media.select("media_key", F.posexplode("variants").alias("at", "v"))
    return each.groupBy("media_key").agg(F.max_by(F.col("v.url"), F.struct(F.coalesce("v.bit_rate", F.lit(-1)), -F.col("at"))).alias("url"))


def attached(posts: DataFrame, media: DataFrame) -> DataFrame:
    """post id, media_key, url; url is null where the media object is missing."""
    keys = posts.select("id", F.explode("attachments.media_keys").alias("media_key"))
    return keys.join(best_variants(media), "media_key", "left")
