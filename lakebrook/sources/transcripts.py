"""Transcript files: cues of SRT, VTT and the like, and lenient reading of text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
#: A line that says when a cue is shown; blank lines part the blocks of a file.
RANGE, BLANK = rf"^[ \t]*({STAMP})[ \t]+-->[ \t]+({STAMP})", r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"
TEXT_SUFFIXES = ("srt", "vtt", "ttml", "ass", "txt", "md", "csv")


def strip(text: Column) -> Column:
    """All Unicode white space at both ends; trim takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, text of every file; bytes that aren't UTF-8 become U+FFFD, as Java decodes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), strip(F.decode("content", "UTF-8")).alias("text"))


def scan_state(spark: SparkSession, state: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of state rows (source_key, video_id, canonical_url, title, published_at, status, transcript_path)
    against the files under path; transcript_path is relative to it. Rows without a transcript_path have nothing to read.

    Files are read by the executors, names first: content is decoded for files that some row names. Warnings are
    MISSING_TRANSCRIPT where there is no such file, UNREADABLE_TRANSCRIPT where its content couldn't be read, and
    EMPTY_TRANSCRIPT where nothing but white space is in it.
    """
    root = path.rstrip("/")
    named = state.where("coalesce(transcript_path, '') <> ''")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    # Files are matched by what follows the root, whatever scheme or host the listing writes before it.
    below = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/"), "^" + re.escape(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", root)) + "/", "")
    texts = files.select(below.alias("transcript_path"), F.lit(True).alias("there"), strip(F.decode("content", "UTF-8")).alias("text"))
    both = named.join(texts, "transcript_path", "left")
    warning = F.when(F.col("there").isNull(), "MISSING_TRANSCRIPT").when(F.col("text").isNull(), "UNREADABLE_TRANSCRIPT").when(F.col("text") == "", "EMPTY_TRANSCRIPT")
    judged = both.withColumn("warning", warning)
    records = judged.where("warning is null").select(
        F.lit("youtube").alias("platform"), "source_key", F.col("video_id").alias("content_id"), "canonical_url", "published_at", "title",
        F.col("source_key").alias("author"), F.lit("transcript").alias("kind"), "text", F.lit("transcript").alias("locator"), F.col("transcript_path").alias("artifact_path"),
    )
    return records, judged.where("warning is not null").select("source_key", "video_id", "transcript_path", "status", "warning")


def cues(items: DataFrame) -> DataFrame:
    """evidence_id, chunk_index, locator, text of items (evidence_id, text): one row for each cue with text; an item
    without any cue is one chunk without a locator. Files are read line by line: a block's first line with a time range
    is its cue's, the lines after it are what is said, and those before it, such as a number, are passed over."""
    blocks = F.transform(F.split("text", BLANK), lambda b: F.split(b, r"\r?\n"))
    timed = lambda lines: F.array_position(F.transform(lines, lambda x: x.rlike(RANGE)), True).cast("int")
    shown = F.filter(blocks, lambda lines: timed(lines) > 0)

    def cue(lines):
        when, said = F.get(lines, timed(lines) - 1), F.slice(lines, timed(lines) + 1, F.size(lines))
        stamps = [F.translate(F.regexp_extract(when, RANGE, i), ",", ".") for i in (1, 2)]
        words = F.filter(F.transform(said, strip), lambda x: x != "")
        return F.struct(F.concat(stamps[0], F.lit("–"), stamps[1]).alias("locator"), F.array_join(words, " ").alias("text"))

    spoken = F.filter(F.transform(shown, cue), lambda c: c["text"] != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("locator"), F.col("text").alias("text")))
    return items.select("evidence_id", F.posexplode(F.when(F.size(shown) > 0, spoken).otherwise(whole)).alias("chunk_index", "c")).select("evidence_id", F.col("chunk_index").cast("long").alias("chunk_index"), "c.locator", "c.text")


def is_valid(text: Column, timed: Column) -> Column:
    """At least one line that is no number or time range and, for timed formats, a cue."""
    spoken = F.exists(F.split(text, "\n"), lambda x: (strip(x) != "") & ~x.rlike(r"^\s*\d+\s*$") & ~x.contains("-->") & (strip(x) != "WEBVTT"))
    return spoken & (~timed | text.rlike(rf"{STAMP}\s+-->\s+{STAMP}"))
