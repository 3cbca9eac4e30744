"""Bounded excerpts of whole sentences around matched chunks, as joins over offsets in the item's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.transcripts import strip

#: Where a sentence ends; a mark is put there.
SENTENCE_END, MARK = r"(?U)([.!?]+[\"')\]]*)(?=\s|$)", "\u0001"
GAP = " […] "


def offsets(chunks: DataFrame) -> DataFrame:
    """evidence_id, chunk_index, text, low, high: where each chunk lies in its item's chunks joined by blanks."""
    kept = chunks.select("evidence_id", "chunk_index", strip(F.col("text")).alias("text")).where("text <> ''")
    before = Window.partitionBy("evidence_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return kept.withColumn("low", low).withColumn("high", F.col("low") + F.length("text"))


def sentence_spans(placed: DataFrame) -> DataFrame:
    """evidence_id, k, sentence, low, high: the sentences of each item, in order, white space between them included."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    whole = placed.groupBy("evidence_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), " ").alias("text"))
    pieces = whole.select("evidence_id", F.posexplode(F.split(F.regexp_replace("text", SENTENCE_END, "$1" + MARK), MARK)).alias("at", "piece"))
    order = Window.partitionBy("evidence_id").orderBy("at")
    high = F.sum(F.length("piece")).over(order)
    spans = pieces.withColumn("high", high).withColumn("low", F.col("high") - F.length("piece")).withColumn("sentence", strip(F.col("piece"))).where("sentence <> ''")
    return spans.select("evidence_id", F.row_number().over(order).alias("k"), "sentence", "low", "high")


def bounded(text, most: int):
    """text, or where it is longer than most, two thirds of that from its start and the rest from its end."""
    head = most * 2 // 3
    cut = F.concat(F.rtrim(F.substring(text, 1, head)), F.lit(GAP), F.ltrim(F.right(text, F.lit(most - head - len(GAP)))))
    return F.when(F.length(text) > most, cut).otherwise(text)


def told(wanted: DataFrame, most: int) -> DataFrame:
    """query_id, evidence_id, snippet of the wanted sentences (query_id, evidence_id, k, sentence): runs of sentences are
    joined by blanks, runs by an ellipsis."""
    run = F.col("k") - F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("k"))
    rows = wanted.withColumn("run", run)
    joined = lambda what, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, what))), lambda x: x[what]), " " if what == "sentence" else GAP)
    runs = rows.groupBy("query_id", "evidence_id", "run").agg(joined("sentence", "k").alias("passage"))
    return runs.groupBy("query_id", "evidence_id").agg(joined("passage", "run").alias("all")).select("query_id", "evidence_id", bounded(F.col("all"), most).alias("snippet"))


def snippets(chunks: DataFrame, matched: DataFrame, most: int = 2400) -> DataFrame:
    """query_id, evidence_id, snippet for matched (query_id, evidence_id, chunk_index): the sentences that touch a matched
    chunk, each with the one before. Texts of unmatched items aren't moved. Where there is an index, its excerpts() gives
    the same from stored places."""
    placed = offsets(chunks.join(matched.select("evidence_id").distinct(), "evidence_id", "left_semi"))
    hit = placed.drop("text").join(matched.select("query_id", "evidence_id", "chunk_index").distinct(), ["evidence_id", "chunk_index"])
    spans = sentence_spans(placed)
    touching = hit.select("query_id", "evidence_id", F.col("low").alias("from"), F.col("high").alias("to")).join(spans, "evidence_id").where("from < high and to > low")
    wanted = touching.select("query_id", "evidence_id", F.explode(F.array(F.col("k") - 1, F.col("k"))).alias("k")).distinct()
    return told(wanted.join(spans.select("evidence_id", "k", "sentence"), ["evidence_id", "k"]), most)
