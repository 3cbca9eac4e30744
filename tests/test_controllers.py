"""Controllers, run log, scans of files and documents, with deterministic clients."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakebrook.functions import ids
from lakebrook.operators import controllers, runs
from lakebrook.operators.loops import Budget, Checkpoints, Rejected
from lakebrook.operators.store import IndexStore
from lakebrook.sources import documents, transcripts
from lakebrook.streaming import progress, runlog

WIDE = Budget(1000, 1000, 1000)


def test_state_rows_meet_their_files(spark, tmp_path):
    root = tmp_path / "a dir+"
    (root / "v").mkdir(parents=True)
    (root / "v" / "1.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    (root / "v" / "2.srt").write_text(" \n\t")
    rows = [("s", "1", "u", "t", None, "COMPLETED", "v/1.srt"), ("s", "2", "u", "t", None, "COMPLETED", "v/2.srt"), ("s", "3", "u", "t", None, "FAILED", "v/3.srt"), ("s", "4", "u", "t", None, "PENDING", None)]
    state = spark.createDataFrame(rows, "source_key string, video_id string, canonical_url string, title string, published_at string, status string, transcript_path string")
    records, warnings = transcripts.scan_state(spark, state, str(root))
    assert [(r.content_id, r.platform, r.text.split("\n")[-1]) for r in records.collect()] == [("1", "youtube", "hello")]
    assert {(r.video_id, r.status, r.warning) for r in warnings.collect()} == {("2", "COMPLETED", "EMPTY_TRANSCRIPT"), ("3", "FAILED", "MISSING_TRANSCRIPT")}


def window(spark, tmp_path, texts):
    rows = [(str(i), f"h{i}", "s", f"2026-01-0{1 + i % 5}", t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "evidence_id string, content_hash string, source_key string, published_at string, text string")
    path = str(tmp_path / documents.snapshot_name(datetime(2026, 1, 1), datetime(2026, 1, 8), ["X"]))
    return path, documents.freeze_window(items, path, datetime(2026, 1, 1), datetime(2026, 1, 8), {"considered": 9}, ["x"])


def test_frozen_windows_are_checked(spark, tmp_path):
    path, told = window(spark, tmp_path, ["one", "two"])
    assert path.endswith("2026-01-01-to-2026-01-08-x") and told["n_items"] == 2
    snapshot, items = documents.load_snapshot(spark, path)
    assert snapshot == told and items.count() == 2
    spark.createDataFrame([("9", "h", "s", "", "other")], items.schema).write.mode("append").parquet(f"{path}/{told['items']}")
    with pytest.raises(documents.Unsupported):
        documents.load_snapshot(spark, path)
    documents.write_document(spark, f"{path}/window.json", told | {"snapshot_version": 7})
    with pytest.raises(documents.Unsupported):
        documents.load_snapshot(spark, path)


def test_suites_are_read_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"case_id": "c1", "question": "q", "required_citation_ids": ["e"]}, {"case_id": "c2"}]}, indent=1))
    path = str(tmp_path / "a.json")
    got = documents.read_cases(spark, [path, path, str(tmp_path / "*.json")]).orderBy("place").collect()
    assert [(r.place, r.case_id, r.required_citation_ids) for r in got] == [(0, "c1", ["e"]), (1, "c2", None)]
    assert documents.read_reports(spark, [path, str(tmp_path / "*.json")], "cases string").count() == 1


def test_research_is_kept_until_the_index_changes(spark, tmp_path):
    store, kept = IndexStore(spark, str(tmp_path / "index")), Checkpoints(tmp_path / "c.json")
    items = spark.createDataFrame([("a", "evaluation of tools\nother"), ("b", "nothing")], "evidence_id string, text string")
    store.refresh(items)
    first = controllers.research("evaluate the tools", store, kept)
    assert first["classification"] == "SUPPORTED" and [e["evidence_id"] for e in first["evidence"]] == ["a"] and first["evidence"][0]["snippet"] == "evaluation of tools"
    assert first["retrieval"]["matched_chunks"] == 1
    assert controllers.research("evaluate the tools", store, kept)["run_id"] == first["run_id"]
    assert controllers.research("evaluate the tools", store, kept, limit=2)["run_id"] != first["run_id"]
    store.refresh(items.where("evidence_id = 'b'"))
    gone = controllers.research("evaluate the tools", store, kept)
    assert gone["classification"] == "INSUFFICIENT_EVIDENCE" and gone["retrieval"]["returned"] == 0
    with pytest.raises(ValueError):
        controllers.research("  ", store, kept)


EVIDENCE = [{"evidence_id": "e1"}, {"evidence_id": "e2"}]
GOOD = {"answer": "a", "classification": "SUPPORTED", "citation_ids": ["e1", "e2"]}


def answers(*replies):
    left, heard = list(replies), []

    def ask(question, evidence, feedback):
        heard.append(feedback)
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply, 0.5

    return ask, heard


def test_tasks_retry_with_what_failed_and_are_cached(tmp_path):
    store = Checkpoints(tmp_path / "c.json")
    ask, heard = answers(GOOD | {"citation_ids": ["e9"]}, Rejected("no JSON"), GOOD)
    task = controllers.Task("t", "q?", WIDE)
    got = controllers.agent_task(task, EVIDENCE, ask, store, "m")
    assert got["outcome"] == "COMPLETED_AFTER_RETRY" and got["model_calls"] == 3 and got["cost_usd"] == 1.0
    assert heard == ["", "citation_validation, citation_coverage", "no JSON"]
    assert controllers.agent_task(task, EVIDENCE, ask, store, "m")["cache_hit"]


@pytest.mark.parametrize(
    ("replies", "budget", "outcome", "reason"),
    [
        ([GOOD], WIDE, "COMPLETED", "QUALITY_GATE_PASSED"),
        ([GOOD | {"classification": "CONFLICTING_EVIDENCE"}], WIDE, "CONFLICTING_EVIDENCE", "QUALITY_GATE_PASSED"),
        ([GOOD | {"classification": "CONFLICTING_EVIDENCE", "citation_ids": ["e1"]}] * 3, WIDE, "ESCALATED_FOR_REVIEW", "QUALITY_GATE_NOT_REACHED"),
        ([controllers.ProviderError("401")], WIDE, "ESCALATED_FOR_REVIEW", "PROVIDER_REQUEST_FAILED"),
        ([controllers.ProviderError("503", True), GOOD], WIDE, "COMPLETED_AFTER_RETRY", "QUALITY_GATE_PASSED"),
        ([GOOD | {"answer": " "}], Budget(10, 0.5, 10), "FAILED_BUDGET", "BUDGET_EXHAUSTED"),
    ],
)
def test_ends_of_tasks(tmp_path, replies, budget, outcome, reason):
    got = controllers.agent_task(controllers.Task("t", "q?", budget), EVIDENCE, answers(*replies)[0], Checkpoints(tmp_path / "c.json"), "m")
    assert (got["outcome"], got["stop_reason"]) == (outcome, reason)
    assert ("human_review" in got) == (outcome in ("ESCALATED_FOR_REVIEW", "FAILED_BUDGET"))


def assess(row):
    if row["text"].startswith("late"):
        raise TimeoutError("late")
    if row["text"].startswith("odd") and row["feedback"] is None:
        return {"raw": "no object", "cost_usd": 0.25}
    label = "SIGNIFICANT" if "big" in row["text"] else "UNSUPPORTED"
    body = {"claimed_change": "c", "problem_addressed": "p", "significance": label, "reason": "r", "supporting_evidence": [{"claim_component": "x", "quote": row["text"]}]}
    return {"raw": json.dumps(body), "cost_usd": 0.25, "output_tokens": 10, "input_tokens": 5, "latency_seconds": 2.0}


def test_digests_resume_rank_and_report(spark, tmp_path):
    path, _ = window(spark, tmp_path, ["small one", "big one", "odd small", "late one", "big two"])
    run = lambda budget, client=assess: controllers.digest(path, str(tmp_path / "out"), spark, client, budget, "m", batch=2)
    cut = run(Budget(3, 100, 100, 1.0))
    assert cut["outcome"] == "FAILED_BUDGET" and cut["usage_totals"]["calls"] == 3
    whole = run(WIDE)
    assert whole["outcome"] == "ESCALATED_FOR_REVIEW" and whole["label_counts"] == {"SIGNIFICANT": 2, "INCREMENTAL": 0, "UNSUPPORTED": 2, "PROMOTIONAL": 0}
    out = f"{tmp_path}/out/{whole['key']}"
    refused = spark.read.parquet(f"{out}/rejected").collect()
    assert [(r.item_id, r.error_type, r.attempts) for r in refused] == [("3", "TimeoutError", 2)]
    places = {(r.label, r.place): r.evidence_id for r in spark.read.parquet(f"{out}/ranked").collect()}
    assert places == {("SIGNIFICANT", 1): "4", ("SIGNIFICANT", 2): "1", ("UNSUPPORTED", 1): "0", ("UNSUPPORTED", 2): "2"} or places == {("SIGNIFICANT", 1): "1", ("SIGNIFICANT", 2): "4", ("UNSUPPORTED", 1): "0", ("UNSUPPORTED", 2): "2"}
    asked = spark.read.parquet(f"{out}/attempts").groupBy("evidence_id").count()
    assert {r.evidence_id: r["count"] for r in asked.collect()} == {"0": 1, "1": 1, "2": 2, "3": 2, "4": 1}
    mended = run(WIDE, lambda row: assess(row | {"text": row["text"].removeprefix("late ")}))
    assert mended["outcome"] == "COMPLETED" and mended["items_assessed"] == 5 and mended["usage_totals"]["calls"] == 8
    assert documents.read_document(spark, f"{out}/report.json")["outcome"] == "COMPLETED"


def test_updates_index_what_is_there_after_a_failure(spark, tmp_path):
    items = spark.createDataFrame([("a", "text")], "evidence_id string, text string")
    warnings = spark.createDataFrame([("w",)], "warning string")

    def ingest():
        raise OSError("no such command")

    got = controllers.library_update(ingest, lambda: (items, warnings), IndexStore(spark, str(tmp_path / "i")), str(tmp_path / "r" / "update.json"))
    assert got["status"] == "COMPLETED_WITH_FAILURES" and got["ingestion_exit_code"] == 127 and got["index"]["inserted"] == 1 and got["index_warning_count"] == 1


def test_events_lose_their_secrets(spark, tmp_path):
    log = runs.RunLog(tmp_path / "l" / "log.jsonl", runs.new_run("DIGEST"))
    log.event("s", status="OK", parameters={"api_key": "k", "args": ["--token", "t", "x"], "url": "https://a/b?sig=1"}, output="Bearer abc", error="e" * 2001)
    row = json.loads((tmp_path / "l" / "log.jsonl").read_text())
    assert tuple(row) == runs.EVENT_KEYS
    assert row["parameters"] == {"api_key": "[REDACTED]", "args": ["--token", "[REDACTED]", "x"], "url": "https://a/b?[QUERY_REDACTED]"}
    assert row["output"] == "Bearer [REDACTED]" and row["error"].endswith("...[TRUNCATED]")
    with pytest.raises(ValueError):
        log.event("s", shape="?")
    events = spark.createDataFrame([("r", "Bearer x", "p", 1)], "run_id string, output string, password string, n int")
    for _ in range(2):
        runs.append_events(events, str(tmp_path / "many"))
    got = spark.read.json(str(tmp_path / "many")).collect()
    assert [(r.output, r.password, r.n) for r in got] == [("Bearer [REDACTED]", "[REDACTED]", 1)] * 2


def test_kinds_and_options():
    with pytest.raises(ValueError):
        runs.new_run("NOPE")
    assert runs.new_run("AGENT_TASK", "p")["parent_run_id"] == "p"
    domains = {"A": ("none", "text"), "B": ("low", "high")}
    assert runs.chosen({"A": " TEXT "}, domains) == {"A": "text", "B": "low"} and runs.chosen({}, domains) == {"A": "none", "B": "low"}
    with pytest.raises(ValueError, match="A: jsn .*; B: x"):
        runs.chosen({"A": "jsn", "B": "x"}, domains)


def test_a_handover_tells_what_its_attempts_say(tmp_path):
    ask, _ = answers(GOOD | {"citation_ids": ["e9"]}, Rejected("no JSON"), GOOD | {"answer": " "})
    got = controllers.agent_task(controllers.Task("t", "q?", WIDE), EVIDENCE, ask, Checkpoints(tmp_path / "c.json"), "m", guidance={"QUALITY_GATE_NOT_REACHED": "read the sources"})
    told = got["human_review"]
    assert told["stop"] == got["stop_reason"] and told["guidance"] == "read the sources" and told["answered_rounds"] == [1, 3]
    assert told["failures"]["citation_validation"] == 1 and told["failures"]["no JSON"] == 1 and told["spent_by_round"] == [0.5, 0.5, 1.0]


def test_a_frozen_window_stays_as_it_is(spark, tmp_path):
    items = spark.createDataFrame([("1", "h", "x")], "evidence_id string, content_hash string, text string")
    path, since, until = str(tmp_path / "w"), datetime(2026, 1, 1), datetime(2026, 1, 8)
    documents.freeze_window(items, path, since, until, {})
    with pytest.raises(FileExistsError):
        documents.freeze_window(items.limit(0), path, since, until, {})
    assert documents.load_snapshot(spark, path)[1].count() == 1
    documents.write_document(spark, f"{path}/other.json", {"n": 1})
    documents.write_document(spark, f"{path}/other.json", {"n": 2})
    assert documents.read_document(spark, f"{path}/other.json") == {"n": 2}
    with pytest.raises(FileExistsError):
        documents.write_document(spark, f"{path}/other.json", {"n": 3}, replace=False)
    assert documents.read_document(spark, f"{path}/other.json") == {"n": 2} and not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".other")and not p.name.endswith(".crc")]


def test_nested_values_lose_their_secrets():
    value = {"a": [{"token": {"deep": "x"}}, ("--api-key", "k", "--plain", "v")], "n": 1.5, "none": None, "Authorization": ["z"], "when": datetime(2026, 1, 1)}
    assert runs.safe(value) == {"a": [{"token": "[REDACTED]"}, ["--api-key", "[REDACTED]", "--plain", "v"]], "n": 1.5, "none": None, "Authorization": "[REDACTED]", "when": "2026-01-01 00:00:00"}
    assert runs.safe("Bearer abc") == "Bearer [REDACTED]" and value["Authorization"] == ["z"]


def test_heartbeat(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"ts": "2026-01-01T00:00:01", "event_type": "a"}\n')
    heard = []
    beat = progress.Heartbeat(heard.append)
    spark.streams.addListener(beat)
    try:
        stream = runlog.read_log(spark, str(tmp_path / "in"), "ts timestamp, event_type string")
        runlog.run_available(stream, str(tmp_path / "cp"), lambda df, n: df.count(), "append")
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(beat)
    kinds = [h["event"] for h in heard]
    assert kinds[0] == "STARTED" and "PROGRESS" in kinds and beat.failed == 0


def test_media_extensions(spark):
    rows = [("https://a/b.JPG?x=1", None), ("https://a/b.exe", "image/png; q=1"), ("https://a/.png", "no/such"), ("https://a/v.x/b", None)]
    got = spark.createDataFrame(rows, "u string, t string").select(ids.media_extension(F.col("u"), F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == [".jpg", ".png", ".bin", ".bin"]
