"""The stored index against its texts, and the commit log under several writers and crashes."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakebrook.operators import block_search, index
from lakebrook.operators import store as store_module
from lakebrook.operators.commits import CommitLog, Conflict, StateTable, attempt
from lakebrook.operators.snippets import snippets
from lakebrook.operators.store import IndexStore


def test_search_of_a_store_with_dead_items_in_many_shards(spark, tmp_path, monkeypatch):
    """Updates and deletions, several segments, shards of few lines: scores, ranks, counts and excerpts equal those of the texts."""
    monkeypatch.setattr(store_module, "SHARD_LINES", 64)
    monkeypatch.setattr(store_module, "CUT", 100)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("evidence_id"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    short = asked.withColumn("query", F.substring_index("query", " ", 4))
    store = IndexStore(spark, str(tmp_path / "index"), ("plain", "stem"))
    store.refresh(docs)
    now = docs.where("evidence_id % 10 <> 3").withColumn("text", F.when(F.expr("evidence_id % 10 = 4"), F.concat("text", F.lit("\n\nonce more the ration was in"))).otherwise(F.col("text"))).cache()
    assert store.refresh(now) == {"inserted": 0, "updated": 20, "reused": 160, "deleted": 20}
    names = ("query_id", "evidence_id", "chunk_index", "score", "rank")
    rows = lambda df, *n: sorted(tuple(r[c] for c in n) for r in df.collect())
    chunks = index.chunks_by_line(now)
    for questions in (asked, short):
        scored = index.bm25(chunks, questions, False).cache()
        for k in (1, 10):
            assert rows(store.top(questions, k, "plain"), *names) == rows(index.top_items(scored, k), *names) != []
        assert rows(store.match_counts(questions, 8, "plain"), "query_id", "matched_chunks", "matched_items", "truncated") == rows(index.match_counts(scored, 8), "query_id", "matched_chunks", "matched_items", "truncated")
        best = index.best_chunks(scored, 4)
        top = index.top_items(best.where("rank = 1").drop("rank"), 10).select("query_id", "evidence_id")
        want = best.join(top, ["query_id", "evidence_id"], "left_semi").cache()
        assert rows(store.best(questions, 4, 10, "plain"), *names) == rows(want, *names)
        assert rows(store.excerpts(want), "query_id", "evidence_id", "snippet") == rows(snippets(chunks, want), "query_id", "evidence_id", "snippet")
    read = store.blocks_read(short, 1, "plain")
    assert 0 < read["read"] < read["blocks"] and read["postings_read"] < read["postings"]
    before = rows(store.top(asked, 10, "stem"), *names)
    store.compact()
    assert len(store.current()["segments"]) == 1 and rows(store.top(asked, 10, "stem"), *names) == before


def test_blocks_that_cannot_reach_the_best_are_passed_over():
    """One term whose blocks differ widely: only those whose bound reaches the k-th best are read; all scores agree."""
    rng = np.random.default_rng(3)
    n = 128 * 40
    tf, dl = np.ones(2 * n, np.int32), np.full(2 * n, 50, np.int32)
    tf[:n][rng.integers(0, 256, 30)] = 40  # rare, strong chunks in two blocks of the first term
    edges = np.arange(0, 2 * n + 1, 128)
    peak_tf, peak_dl, at = block_search.frontiers(tf, dl, edges)
    bound = np.maximum.reduceat(block_search.gain(peak_tf.astype(float), peak_dl.astype(float), 40.0), at[:-1])
    numbers = np.r_[np.arange(n), np.arange(n)]
    make = lambda: block_search.Shard(["a", "b"], np.array([0, 40, 80]), numbers[edges[:-1]], numbers[edges[1:] - 1], bound, edges, numbers, numbers // 2, tf, dl, 40.0, np.array([0]))
    shard, asked = make(), [("a", 3.0), ("b", 0.01)]
    found, items, scores = shard.top(asked, 5)
    every, of, all_scores = make().all(asked)
    best = sorted(((max(all_scores[of == i]), i) for i in np.unique(of)), key=lambda x: (-x[0], x[1]))[:5]
    got = sorted(((max(scores[items == i]), i) for i in np.unique(items)), key=lambda x: (-x[0], x[1]))[:5]
    assert got == best and 0 not in items
    assert shard.counts["blocks"] == 80 and shard.counts["read"] < 50


@pytest.mark.parametrize("seed", range(4))
def test_frontiers_bound_every_posting(seed):
    rng = np.random.default_rng(seed)
    tf, dl = rng.integers(1, 9, 500), rng.integers(1, 60, 500)
    edges = np.unique(np.r_[0, rng.integers(1, 500, 40), 500])
    peak_tf, peak_dl, at = block_search.frontiers(tf, dl, edges)
    for b in range(len(edges) - 1):
        pairs = list(zip(peak_tf[at[b] : at[b + 1]], peak_dl[at[b] : at[b + 1]]))
        own = list(zip(tf[edges[b] : edges[b + 1]], dl[edges[b] : edges[b + 1]]))
        assert set(pairs) <= set(own) and all(any(t >= x and d <= y for t, d in pairs) for x, y in own)
        assert all(not (t >= u and d <= v) for t, d in pairs for u, v in pairs if (t, d) != (u, v))


def test_of_two_writers_one_commits_and_the_other_starts_again(spark, tmp_path):
    """Two refreshes read version 1; the second finds 2 taken, and works again from there. Nothing of either is lost."""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.refresh(spark.createDataFrame([(1, "alpha"), (2, "beta")], "evidence_id long, text string"))
    rival, seen = IndexStore(spark, str(tmp_path / "index")), []
    plain = store._refreshed

    def slow(items, base):
        made = plain(items, base)
        seen.append(base)
        if len(seen) == 1:
            rival.refresh(spark.createDataFrame([(1, "alpha"), (2, "beta two")], "evidence_id long, text string"))
        return made

    store._refreshed = slow
    told = store.refresh(spark.createDataFrame([(1, "alpha one"), (2, "beta two")], "evidence_id long, text string"))
    assert seen == [1, 2] and told == {"inserted": 0, "updated": 1, "reused": 1, "deleted": 0}
    assert store.log.latest() == 3 and sorted(r.term for r in store.table("postings").collect()) == ["alpha", "beta", "on", "two"]


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.refresh(spark.createDataFrame([(1, "alpha")], "evidence_id long, text string"))
    asked = spark.createDataFrame([(1, "alpha gamma")], "query_id long, query string")
    for step in ("_write_segment", "_write_terms", "_made"):
        with monkeypatch.context() as m:
            real = getattr(IndexStore, step)
            m.setattr(IndexStore, step, lambda *a, real=real, **k: (real(*a, **k), 1 / 0))
            with pytest.raises(ZeroDivisionError):
                store.refresh(spark.createDataFrame([(2, "gamma")], "evidence_id long, text string"))
        assert store.log.latest() == 1 and [r.evidence_id for r in store.search(asked).collect()] == [1]
    assert store.refresh(spark.createDataFrame([(2, "gamma")], "evidence_id long, text string"))["deleted"] == 1
    assert [r.evidence_id for r in store.search(asked).collect()] == [2]


def test_an_entry_is_put_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.latest() == 0
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.put(1, {"by": i}), range(24)))
    assert won.count(True) == 1 and log.latest() == 1 and log.read(1) == {"by": won.index(True), "version": 1}
    with pytest.raises(Conflict):
        attempt(log, lambda base: (log.put(base + 1, {}) and {}, None), tries=3)


def test_state_tables_take_each_batch_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    table = StateTable(spark, str(tmp_path), ["k"], ("n",))
    assert table.read() is None
    assert table.upsert(rows(("a", 1), ("b", 1)), ("q", 0)) == 1 and table.upsert(rows(("a", 2)), ("q", 1)) == 2
    assert table.upsert(rows(("a", 1), ("b", 1)), ("q", 0)) == 2  # delivered again: nothing changes
    assert table.upsert(rows(("c", 7)), ("other", 0)) == 3
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 1), ("c", 7)] and sorted(map(tuple, table.read(1).collect())) == [("a", 1), ("b", 1)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: StateTable(spark, str(tmp_path), ["k"], ("n",)).upsert(rows((f"w{i}", i))), range(3)))
    assert table.log.latest() == 6 and {r.k for r in table.read().collect()} == {"a", "b", "c", "w0", "w1", "w2"}
