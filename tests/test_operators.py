"""The reference's operators on small, hand-made corpora."""

import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakebrook.functions import ids, text, times
from lakebrook.operators import containment, evaluation, index, loops, state, window
from lakebrook.operators import store as store_module
from lakebrook.operators.commits import CommitLog
from lakebrook.operators.snippets import snippets
from lakebrook.operators.store import IndexStore
from lakebrook.sources import adapters, manifest, posts, transcripts
from lakebrook.streaming import runlog


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_stems():
    for a, b in (("reliability", "reliable"), ("evaluate", "evaluation"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relate"), ("hopping", "hop")):
        assert text.porter(a) == text.porter(b)
    assert [text.porter(w) for w in ("sky", "agreed", "plastered", "motoring", "sized", "controll", "feed")] == ["sky", "agre", "plaster", "motor", "size", "control", "feed"]


def test_stemmed_search_equals_brute_force(spark):
    texts = ["An evaluation of reliable tools", "evaluating the tool, évaluation", "nothing of the kind", "Reliability is evaluated", "tools"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "evidence_id long, chunk_index long, text string")
    asked = {1: "evaluate reliability", 2: "the tool", 3: "what is the", 4: "evaluating evaluation"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = {(r.query_id, r.evidence_id): r.score for r in index.bm25(chunks, queries).collect()}
    plain = lambda w: text.porter(w.translate(str.maketrans(*text.ACCENTS)))
    docs = [[plain(w) for w in re.findall(r"\w+", t.lower())] for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    want = {}
    for q, a in asked.items():
        for term in {plain(w) for w in a.split() if w not in text.STOP_WORDS}:
            df = sum(term in x for x in docs)
            for i, x in enumerate(docs):
                if tf := x.count(term):
                    idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
                    want[q, i] = want.get((q, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert {i for q, i in got if q == 1} == {0, 1, 3} and not index.bm25(chunks, queries, stemmed=False).where("query_id = 4 and evidence_id = 3").count()


def test_query_terms_lose_stop_words_and_keep_repeats(spark):
    assert one(spark, text.query_terms(F.col("q")), q="What is the Überprüfung of the_index the index? index") == ["überprüfung", "the_index", "index", "index"]
    assert one(spark, text.query_terms(F.col("q")), q="what is the") == []


def test_captions_lose_their_overlap():
    assert text.rolled(["so this is", "this is the way", "this is the way", "", None, "way we go"]) == "so this is the way we go"
    assert text.rolled([]) == "" and text.rolled(["a b", "a b"]) == "a b"


def test_rolled_captions_equal_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        captions = [" ".join(rng.choice(("a", "b", "aa", "ab")) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 8))]
        said = ""
        for c in captions:
            new = c[max(k for k in range(len(c) + 1) if said.endswith(c[:k])) :].strip()
            said = f"{said} {new}".strip()
        assert text.rolled(captions) == said


def test_excerpts_keep_sentences_and_gaps(spark):
    pieces = [(0, "It does"), (1, " not work."), (2, "Nobody knows why."), (3, " "), (4, "Really!"), (5, "More."), (6, "End.")]
    chunks = spark.createDataFrame([("i", n, t) for n, t in pieces] + [("j", 0, "x" * 9000), ("k", 0, "no hit")], "evidence_id string, chunk_index long, text string")
    hits = {1: (0,), 2: (2,), 3: (0, 6), 4: (2, 6)}
    matched = spark.createDataFrame([(q, "i", n) for q, ns in hits.items() for n in ns] + [(5, "j", 0)], "query_id long, evidence_id string, chunk_index long")
    got = {r.query_id: r.snippet for r in snippets(chunks, matched).collect()}
    assert got[1] == "It does not work." and got[2] == "It does not work. Nobody knows why."
    assert got[3] == "It does not work. […] More. End." and got[4] == "It does not work. Nobody knows why. […] More. End."
    assert len(got) == 5 and len(got[5]) == 2400 and " […] " in got[5]


def test_cues(spark):
    srt = "1\n00:01:02,000 --> 00:01:03,000\nHello\nthere\n\n2\n00:01:04.500 --> 00:01:05.000\n\n\n00:01:06,000 --> 00:01:07,000\nBye"
    df = spark.createDataFrame([(1, srt), (2, "no cues here")], "evidence_id long, text string")
    got = sorted((r.evidence_id, r.chunk_index, r.locator, r.text) for r in transcripts.cues(df).collect())
    assert got[0] == (1, 0, "00:01:02.000–00:01:03.000", "Hello there") and got[-1] == (2, 0, None, "no cues here")
    assert [g[3] for g in got if g[0] == 1] == ["Hello there", "Bye"]


def test_timestamps(spark):
    for raw, want in (("2026-08-06T10:00:00+02:00", "2026-08-06 08:00:00"), ("2026-08-06T10:00:00.000Z", "2026-08-06 10:00:00"), ("2026-08-06", "2026-08-06 00:00:00"), ("20260806", "2026-08-06 00:00:00"), ("2026", None), ("12:30", None), ("junk", None), ("  ", None)):
        assert one(spark, F.date_format(times.normalize_ts(F.col("v")), "yyyy-MM-dd HH:mm:ss"), v=raw) == want, raw
    assert one(spark, times.strict_ts(F.col("v")), v="2026-08-06T10:00:00") is None


def test_windows_tile_and_count(spark):
    rows = [(i, " YouTube" if i % 2 else "x", datetime(2026, 1, 1 + i // 4, 6 * (i % 4)) if i != 5 else None, "text" if i else "[MUSIC]") for i in range(12)]
    df = spark.createDataFrame(rows, "evidence_id long, platform string, published_at timestamp, text string")
    days = [window.select_window(df, datetime(2026, 1, d), datetime(2026, 1, d + 1)).count() for d in (1, 2, 3)]
    assert sum(days) == 11 == window.select_window(df, datetime(2026, 1, 1), datetime(2026, 1, 4)).count()
    assert tuple(window.window_counters(df, datetime(2026, 1, 1), datetime(2026, 1, 2), ["youtube "]).first()) == (6, 2, 1)
    assert window.exclude_non_substantive(df).count() == 11
    with pytest.raises(ValueError):
        window.select_window(df, datetime(2026, 1, 2), datetime(2026, 1, 2))


def test_refreshing_twice_reuses_all(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    items = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "delta"), (3, "epsilon")], "evidence_id long, text string")
    assert store.refresh(items) == {"inserted": 3, "updated": 0, "reused": 0, "deleted": 0}
    assert store.refresh(items) == {"inserted": 0, "updated": 0, "reused": 3, "deleted": 0}
    changed = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "delta two"), (4, "zeta")], "evidence_id long, text string")
    assert store.refresh(changed) == {"inserted": 1, "updated": 1, "reused": 1, "deleted": 1}
    assert sorted(r.term for r in store.table("postings").collect()) == ["alpha", "beta", "delta", "gamma", "two", "zeta"]
    store.compact()
    assert sorted(r.term for r in store.table("postings").collect()) == ["alpha", "beta", "delta", "gamma", "two", "zeta"]
    assert store.refresh(changed) == {"inserted": 0, "updated": 0, "reused": 3, "deleted": 0}


def test_search_of_the_stored_index_equals_search_of_its_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("evidence_id"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    store = IndexStore(spark, str(tmp_path / "index"))
    store.refresh(docs.withColumn("text", F.concat("text", F.lit(" once"))))
    store.refresh(docs.where("evidence_id <> 3"))
    want = index.bm25(index.chunks_by_line(docs.where("evidence_id <> 3")), asked)
    pushed = store.search(asked)
    assert sorted(map(tuple, pushed.collect())) == sorted(map(tuple, want.collect())) != []
    store_module.PUSHED_TERMS, kept = 1, store_module.PUSHED_TERMS
    try:
        assert sorted(map(tuple, store.search(asked).collect())) == sorted(map(tuple, want.collect()))
    finally:
        store_module.PUSHED_TERMS = kept
    assert store.search(spark.createDataFrame([(1, "what is the")], "query_id long, query string")).count() == 0


def test_a_newer_index_is_refused(spark, tmp_path):
    assert CommitLog(spark, str(tmp_path)).put(1, {"schema": 99})
    with pytest.raises(store_module.NewerIndex):
        IndexStore(spark, str(tmp_path)).current()


def test_batches_of_queries_rank_and_count(spark):
    chunks = spark.createDataFrame([(1, 0, "cats and dogs"), (1, 1, "cats cats"), (2, 0, "dogs run"), (3, 0, "birds"), (4, 0, "fish"), (5, 0, "bees")], "evidence_id long, chunk_index long, text string")
    queries = spark.createDataFrame([(1, "where are the cats"), (2, "the of")], "query_id long, query string")
    scored = index.bm25(chunks, queries)
    assert [(r.evidence_id, r.chunk_index) for r in index.top_items(scored, 3).collect()] == [(1, 1)]
    assert tuple(index.match_counts(scored, 1).first()) == (1, 2, 1, 1, True, False)


def test_registry_rules(spark):
    rows = [("a", 1, "COMPLETED", "2026-01-02"), ("a", 2, "FAILED_X", "2026-01-09"), ("b", 3, "PENDING", "2026-01-03")]
    df = spark.createDataFrame(rows, "source_key string, content_id long, status string, published_at string")
    cursors = state.terminal_cursor(df, ["source_key"])
    assert {r.source_key: r.cursor for r in cursors.collect()} == {"a": "2026-01-02", "b": None}
    assert {r.content_id for r in state.after_cursor(df, cursors, ["source_key"]).collect()} == {2, 3}
    stored = spark.createDataFrame([("a", "2026-03-01"), ("c", "2026-02-02")], "source_key string, cursor string")
    assert {r.source_key: r.cursor for r in state.terminal_cursor(df, ["source_key"], stored).collect()} == {"a": "2026-03-01", "b": None, "c": "2026-02-02"}
    twice = spark.createDataFrame([("b", 3, "FAILED", "2026-06-01"), ("b", 3, "COMPLETED", "2026-07-01"), ("b", 3, "PENDING", "2026-05-01")], df.schema)
    assert [r.status for r in state.upsert(df, twice, ["source_key", "content_id"], ["published_at"]).where("content_id = 3").collect()] == ["COMPLETED"]
    new = spark.createDataFrame([("a", 1, "COMPLETED", "2026-05-05")], df.schema)
    assert state.identity_conflicts(df, new, ["source_key", "content_id"], ["published_at"]).count() == 1
    assert state.upsert(df, new, ["source_key", "content_id"]).count() == 3
    _, overlap = state.merge_alias(df, "source_key", "b", "a", "content_id")
    assert overlap.count() == 0


@pytest.mark.parametrize("most, size, short", [(1 << 25, 1 << 20, 1 << 20), (40, 1 << 20, 1 << 20), (1 << 25, 50, 30)])
def test_holding_equals_comparing_every_pair(spark, monkeypatch, most, size, short):
    """Quotes that travel, quotes too large for that, and many slices and automata."""
    monkeypatch.setattr(containment, "SLICE", size)
    monkeypatch.setattr(containment, "SHORT_BYTES", short)
    rng = random.Random(2)
    word = lambda: rng.choice(("a", "ab", "b", "ba", "c", "straße"))
    gap = lambda: rng.choice((" ", " ", "\n", "  ", "\u00a0"))
    texts = [(i, "".join(word() + gap() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, None), (98, "")]
    quotes = [(i, " ".join(word() for _ in range(rng.randint(0, 7)))) for i in range(60)] + [(70, texts[3][1]), (71, "b a"), (72, None), (73, "b a"), (74, " ")]
    quotes += [(80 + i, t[1:-1]) for i, (_, t) in enumerate(texts[:10])]
    t, q = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    found = containment.holding(t, q, most)
    assert sorted((r.text_id, r.quote_id) for r in found.collect()) == sorted((i, k) for i, x in texts for k, y in quotes if x is not None and y and y in x)
    assert all(r.text == dict(texts)[r.text_id] and r.quote == dict(quotes)[r.quote_id] for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and (most == 40 or "Exchange" not in plan and "Generate" not in plan)
    assert containment.holding(t, q.where("quote_id < 0"), most).count() == 0


def test_a_filter_passes_every_anchor_and_little_else():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    known = containment.Quotes([" ".join(rng.choices(words, k=9)) for _ in range(3000)])
    passed = lambda hashes: np.all([(known.filter[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) for b in known._bits(hashes)], axis=0)
    assert passed(known.hashes).all()
    others = np.array([rng.getrandbits(64) for _ in range(100000)], np.uint64)
    assert passed(others).mean() < 0.01


def test_grounding_folds_case_as_unicode_says(spark):
    assert one(spark, text.grounded(F.col("q"), F.col("t")), q="STRASSE  zum", t="die Straße zum See")
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and chr(i) != chr(i).casefold()]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", text.casefold(F.col("c")).alias("f")).collect()
    cherokee = {c for c in letters if "\u13a0" <= c <= "\u13fd" or "\uab70" <= c <= "\uabbf"}
    assert all(r.f == r.c.casefold() for r in rows if r.c not in cherokee) and len(rows) > 1000
    assert all(r.f == r.c.casefold().lower() for r in rows if r.c in cherokee)  # the same pairs
    assert one(spark, text.casefold(F.col("t")), t="ΟΔΟΣ ςΣ ŉ İı ﬃ 😀ẞ") == "ΟΔΟΣ ςΣ ŉ İı ﬃ 😀ẞ".casefold()


def test_allocations():
    for counts, size in (({"H": 3, "M": 3, "L": 3}, 7), ({"H": 1, "M": 9, "L": 2}, 9), ({"M": 5}, 5), ({"H": 4, "M": 4, "L": 1}, 8)):
        want = {x: 0 for x in ("H", "M", "L") if counts.get(x)}
        for _ in range(size):
            x = min((x for x in want if want[x] < counts[x]), key=lambda x: (want[x], "HML".index(x)))
            want[x] += 1
        assert evaluation.allocations(counts, size, ("H", "M", "L")) == want
    assert evaluation.allocations({"H": 10, "M": 1, "L": 9}, 10, ("H", "M", "L", "N")) == {"H": 5, "M": 1, "L": 4}
    with pytest.raises(ValueError):
        evaluation.allocations({"H": 1, "M": 1}, 1, ("H", "M"))


def test_scope_lint_and_json(spark):
    answers = ["The corpus proves it.", "It does not show that the field agrees.", "Industry consensus. No sources disagree.", None]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [len(r[0]) for r in df.select(text.scope_violations(F.col("a"))).collect()] == [1, 0, 2, 0]
    for raw, want in (('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 2}\n``` y', '{"a": 2}'), ('so {"a": 3} then', '{"a": 3}'), ("nothing", None), ("[1]", None)):
        assert one(spark, text.extract_json_object(F.col("r")), r=raw) == want


def test_redaction(spark):
    assert one(spark, text.redact(F.col("v")), v="Bearer abc https://h/p?sig=1 " + "x" * 3000).startswith("Bearer [REDACTED] https://h/p?[QUERY_REDACTED] x")
    df = spark.createDataFrame([(["run", "--api-key", "k", "v"],)], "a array<string>")
    assert df.select(text.redact_arguments(F.col("a"))).first()[0] == ["run", "--api-key", "[REDACTED]", "v"]


def test_urls_and_folders(spark):
    assert one(spark, ids.canonical_url(F.lit("YouTube"), F.col("u")), u=" HTTPS://YouTube.com/@a/videos/?x=1#y ") == "https://youtube.com/@a"
    assert one(spark, ids.canonical_url(F.lit("x"), F.col("u")), u="plain/") == "plain"
    assert one(spark, ids.content_folder(F.lit("2026-08-06").cast("date"), F.col("i")), i="../x") is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.md").write_text("# Sources\n\n| Platform | Handle | Name | URL | Type | Notes |\n|---|---|---|---|---|---|\n| youtube | @a | A | https://www.youtube.com/@a | channel | |\n| x | @a | A | https://x.com/a | user | |\n| x | @a | B | https://y.com/b | user | |\n")
    rows = manifest.read_manifest(spark, str(tmp_path / "m.md"))
    assert rows.count() == 3
    assert sorted((r.platform, r.problem) for r in manifest.problems(rows).collect()) == [("x", "REPEATED_HANDLE"), ("x", "WRONG_URL")]


def test_posts(spark, tmp_path):
    d = tmp_path / "x" / "posts" / "20260101_42"
    d.mkdir(parents=True)
    (d / "post.json").write_text('{"text": "hi", "attachments": {"media_keys": ["m1", "m2"]}}')
    (d / "brief.pdf").write_bytes(b"%PDF")
    got = posts.read_posts(spark, str(tmp_path))
    assert got.first().id == "42" and posts.unextracted(spark, str(tmp_path)).count() == 1
    media = spark.createDataFrame([("m1", [("u1", 5), ("u2", 9), ("u3", 9), ("u4", None)])], "media_key string, variants array<struct<url: string, bit_rate: int>>")
    assert {r.media_key: r.url for r in posts.attached(got, media).collect()} == {"m1": "u2", "m2": None}


class Numbers:
    def __init__(self, options):
        self.n = int(options["n"])

    def partitions(self):
        return list(range(self.n))

    def collect(self, item):
        yield ("p", "s", str(item), "u", None, None, None, "k", f"text {item}", None, "a", "EXTRACTED")


def test_adapters_are_a_data_source(spark):
    adapters.register(spark)
    rows = spark.read.format("evidence").option("adapter", "tests.test_operators:Numbers").option("n", "3").load()
    try:
        assert sorted(r.text for r in rows.collect()) == ["text 0", "text 1", "text 2"]
    except Exception as e:  # workers find the tests only when they run from the repository's folder
        if "No module named 'tests'" not in str(e):
            raise


def test_loops_stop_resume_and_reject(tmp_path):
    units, seen = [(str(i), i) for i in range(6)], []

    def perform(i):
        seen.append(i)
        if i == 2:
            raise loops.Rejected("no quote")
        return i * 10, 0.1

    store = loops.Checkpoints(tmp_path / "c.json")
    first = loops.run_units(units, "k", loops.Budget(5, 10, 10), store, perform)
    assert first.outcome == "BUDGET_STOP" and first.calls == 4
    second = loops.run_units(units, "k", loops.Budget(50, 10, 10), store, perform)
    assert second.outcome == "PARTIAL" and set(second.rejected) == {"2"} and seen.count(0) == 1
    (tmp_path / "c.json").write_text("{broken")
    assert store.load("k") is None


def test_retrieval_retry():
    answers = iter([{"classification": "INSUFFICIENT_EVIDENCE", "relevant": 0, "suggested_queries": ["q"]}, {"classification": "SUPPORTED", "relevant": 2, "suggested_queries": []}])
    got = loops.retrieval_retry("?", [{"evidence_id": 1}], lambda q, e: next(answers), lambda q: [{"evidence_id": 1}, {"evidence_id": 2}], rounds=3)
    assert got["stop"] == "QUALITY_GATE_PASSED" and len(got["evidence"]) == 2


def test_streamed_log_equals_its_batch_twin(spark, tmp_path):
    logs = tmp_path / "log"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"ts": "2026-01-01T00:00:01", "event_type": "a"}\nbroken\n{"ts": "2026-01-01T05:00:00", "event_type": "a"}\n{"ts": "2026-01-02T00:00:00", "event_type": "b"}\n')
    stream = runlog.read_log(spark, str(logs), "ts timestamp, event_type string").where("ts is not null")
    seen = {}
    runlog.run_available(runlog.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour"), str(tmp_path / "cp"), lambda df, n: seen.update({(r.event_type, str(r.start_at)): r.n for r in df.collect()}))
    assert seen == {("a", "2026-01-01 00:00:00"): 2, ("b", "2026-01-02 00:00:00"): 1}


def test_completeness_has_no_bound_of_ids(spark, tmp_path):
    from lakebrook.plans.registry import QUERIES

    spark.createDataFrame([(1,), (499,), (500,), (9000,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,), (500,), (9001,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    got = {tuple(r) for r in QUERIES["completeness_check"](spark, str(tmp_path)).collect()}
    assert got == {(499, "missing"), (9000, "missing"), (9001, "unexpected")}
