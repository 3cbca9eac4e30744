"""The inverted index: chunks, postings, BM25 for batches of queries, best chunks, refresh by difference.

Chunk ids are (evidence_id, chunk_index). All queries of a batch are answered in one plan: query terms meet the postings
on the term, so a term's postings are read once however many queries use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, stem, tokens, without_accents

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def chunks_by_line(items: DataFrame) -> DataFrame:
    """evidence_id, chunk_index (from 0), text of every non-blank line."""
    lines = items.select("evidence_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return lines.select("evidence_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.trim("text").alias("text")).where("text <> ''")


def postings(chunks: DataFrame) -> DataFrame:
    """term, evidence_id, chunk_index, dl, tf: stems of the chunks' words. Words are counted within their chunk before they
    are stemmed, so that no term, however frequent, is gathered in one task."""
    words = chunks.select("evidence_id", "chunk_index", tokens(F.col("text")).alias("words")).select("evidence_id", "chunk_index", F.size("words").cast("long").alias("dl"), F.explode("words").alias("word"))
    stems = words.groupBy("evidence_id", "chunk_index", "dl", "word").agg(F.count("*").alias("tf")).withColumn("term", stem(without_accents(F.col("word"))))
    return stems.groupBy("term", "evidence_id", "chunk_index", "dl").agg(F.sum("tf").alias("tf"))


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, term of queries (query_id, query): distinct terms without stop words."""
    return queries.select("query_id", F.explode(F.array_distinct(query_terms(F.col("query")))).alias("term"))


def stems_of(terms: DataFrame) -> DataFrame:
    """term, stem of the distinct terms: without accents, by Porter's steps. An Arrow function, on each term once."""
    return terms.select("term").distinct().withColumn("stem", stem(without_accents(F.col("term"))))


def bm25(chunks: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """query_id, evidence_id, chunk_index, score (rounded to 6 places) of every matching chunk.

    Chunks are exploded only into the terms that some query has: the set of these terms is small and filters before the
    shuffle; where it isn't, Catalyst joins it like any other table. Stemmed, terms match where their stems are equal:
    the corpus's vocabulary is stemmed once, and its terms of wanted stems stand for these from there on.
    """
    wanted = terms_of(queries)
    words = chunks.select("evidence_id", "chunk_index", tokens(F.col("text")).alias("words")).select("evidence_id", "chunk_index", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    if stemmed:
        wanted = wanted.join(stems_of(wanted), "term").select("query_id", F.col("stem").alias("term")).distinct()
        known = stems_of(words).join(wanted.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
        used = words.join(known, "term").withColumn("term", F.col("stem"))
    else:
        used = words.join(wanted.select("term").distinct(), "term", "left_semi")
    found = used.groupBy("term", "evidence_id", "chunk_index", "dl").agg(F.count("*").alias("tf"))
    total = chunks.select(F.size(tokens(F.col("text"))).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return score(found, wanted, total)


def score(found: DataFrame, wanted: DataFrame, total: DataFrame) -> DataFrame:
    """BM25 of found (term, evidence_id, chunk_index, dl, tf), all postings of the terms in wanted (query_id, term), in a
    corpus of total (n, avgdl: one row)."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weighted = df.crossJoin(total).select("term", idf.alias("idf"), "avgdl")  # total is one row
    gain = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(weighted, "term").select("term", "evidence_id", "chunk_index", gain.alias("gain"))
    return wanted.join(scored, "term").groupBy("query_id", "evidence_id", "chunk_index").agg(F.round(F.sum("gain"), 6).alias("score"))


def best_chunks(scored: DataFrame, per_item: int = 1) -> DataFrame:
    order = Window.partitionBy("query_id", "evidence_id").orderBy(F.col("score").desc(), F.col("chunk_index"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= per_item)


def top_items(scored: DataFrame, k: int) -> DataFrame:
    """Each query's k best items by their best chunk; ties to the smaller evidence_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("evidence_id"))
    return best_chunks(scored).drop("rank").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def match_counts(scored: DataFrame, k: int) -> DataFrame:
    """Matched chunks and items, returned items, truncated: fewer items came back than chunks matched."""
    counts = scored.groupBy("query_id").agg(F.count("*").alias("matched_chunks"), F.countDistinct("evidence_id").alias("matched_items"))
    returned = F.least(F.col("matched_items"), F.lit(k).cast("long"))
    return counts.select("query_id", "matched_chunks", "matched_items", returned.alias("returned"), (returned < F.col("matched_chunks")).alias("truncated"), (returned < F.col("matched_items")).alias("truncated_items"))


def refresh_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """evidence_id, action of indexed (evidence_id, content_hash, index_version, has_chunks) against collected
    (evidence_id, content_hash, index_version): inserted, updated, reused or deleted."""
    a = old.select("evidence_id", F.col("content_hash").alias("old_hash"), F.col("index_version").alias("old_version"), "has_chunks")
    b = new.select("evidence_id", F.col("content_hash").alias("new_hash"), F.col("index_version").alias("new_version"))
    same = (F.col("old_hash") == F.col("new_hash")) & (F.col("old_version") == F.col("new_version")) & F.col("has_chunks")
    action = F.when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash").isNull(), "inserted").when(same, "reused").otherwise("updated")
    return a.join(b, "evidence_id", "full_outer").select("evidence_id", action.alias("action"))


def fingerprint(items: DataFrame) -> DataFrame:
    """One row: n and a fingerprint of (evidence_id, content_hash), the same whatever the order; no row list is built."""
    h = F.sha2(F.concat_ws("\x1f", F.col("evidence_id").cast("string"), "content_hash"), 256)
    parts = [F.bit_xor(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    one = items.agg(F.count("*").alias("n"), *parts)
    return one.select("n", F.concat_ws("-", *[F.coalesce(F.col(f"x{i}"), F.lit(0)).cast("string") for i in range(4)]).alias("fingerprint"))
