"""Search by reading the texts: the rows of scoring every chunk, and next to nothing on disk."""

import os

import pytest
from pyspark.sql import functions as F

from lakebrook.operators import index
from lakebrook.operators import scan as scan_module
from lakebrook.operators.scan import Scan
from lakebrook.plans.registry import QUERIES
from lakebrook.session import shared_folder

SF, DOCS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAMES = ("query_id", "evidence_id", "chunk_index", "score", "rank")
COUNTS = ("query_id", "matched_chunks", "matched_items", "returned", "truncated", "truncated_items")


def as_rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def files(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, found in os.walk(folder) for f in found)


def shuffled(spark):
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


@pytest.mark.parametrize("name", ["retrieval_recall", "snippet", "bm25_stemmed", "match_indexes", "match_counts", "best_chunk"])
def test_no_text_or_posting_is_shuffled_or_stored(spark, tmp_path, name):
    """An excerpt moves its item's text; there are few of these where questions are few."""
    (tmp_path / "sf").mkdir()
    (tmp_path / "sf/documents.parquet").symlink_to(f"{DOCS}/documents.parquet")
    spark.read.parquet(f"{DOCS}/benchmark.parquet").limit(2 if name == "snippet" else 1000).write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    folder = shared_folder(spark).removeprefix("file://")
    before = shuffled(spark) + files(folder)
    QUERIES[name](spark, str(tmp_path / "sf")).write.format("noop").mode("overwrite").save()
    texts = spark.read.parquet(f"{DOCS}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark) + files(folder) - before < texts / 2


@pytest.mark.parametrize("analyzer", ["plain", "stem"])
@pytest.mark.parametrize("cells, batch, terms", [(1 << 19, 10_000, 1 << 18), (300, 7, 200), (40, 3, 1 << 18)])
def test_scan_equals_scoring_every_chunk(spark, monkeypatch, analyzer, cells, batch, terms):
    """Items over several batches and longer than a block of scores, questions in several turns, ids of letters with ties."""
    monkeypatch.setattr(scan_module, "CELLS", cells)
    monkeypatch.setattr(scan_module, "MOST_TERMS", terms)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
        odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n \t\n..\n"), (-4, "the Ration\n\nration\nration ration"), (-5, "the Ration\n\nration\nration ration")], "doc_id long, text string")
        items = docs.select("doc_id", "text").unionByName(odd).select(F.concat(F.lit("e"), F.col("doc_id")).alias("evidence_id"), "text")
        asked = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 12").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        asked = asked.unionByName(spark.createDataFrame([(900, "ration"), (901, "the of"), (902, ""), (903, None), (904, "zzzqqq")], "query_id long, query string"))
        scored = index.bm25(index.chunks_by_line(items), asked, analyzer == "stem").cache()
        best, top = index.best_chunks(scored, 4), index.top_items(scored, 3)
        scan = Scan(items, asked, analyzer)
        assert (len(scan.turns) > 1) == (terms == 200)
        assert as_rows(scan.best(1).drop("rank"), *NAMES[:4]) == as_rows(index.best_chunks(scored), *NAMES[:4]) != []
        assert as_rows(scan.best(4), *NAMES) == as_rows(best, *NAMES)
        assert as_rows(scan.top(3), *NAMES) == as_rows(top, *NAMES)
        assert as_rows(scan.best(4, 3), *NAMES) == as_rows(best.join(top.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_semi"), *NAMES)
        assert as_rows(scan.match_counts(2), *COUNTS) == as_rows(index.match_counts(scored, 2), *COUNTS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scan_without_questions_or_texts(spark):
    items = spark.createDataFrame([(1, "alpha")], "evidence_id long, text string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    for scan in (Scan(items, asked.where("query_id < 0")), Scan(items.where("evidence_id < 0"), asked)):
        assert scan.best().collect() == scan.top(3).collect() == scan.match_counts(3).collect() == []
