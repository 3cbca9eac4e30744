"""Synthesis, comparisons, suites, triggers, drafts, audits, ingestion, settings and paging, with deterministic clients."""

import json
import os

import pytest

from lakebrook.operators import experiments as ex
from lakebrook.operators.controllers import ProviderError, Task
from lakebrook.operators.loops import Budget, Rejected
from lakebrook.sources import paging, settings

WIDE = Budget(1000, 1000, 1000)
EVIDENCE = [{"evidence_id": "e1", "snippet": "Tools  are Evaluated daily."}, {"evidence_id": "e2", "snippet": "b"}]
SAID = {
    "answer": " It is so. ", "classification": "SUPPORTED", "citation_ids": ["e1", "e2"], "suggested_queries": [" more "],
    "evidence_assessment": [{"evidence_id": "e1", "relevant": True, "reason": "r"}, {"evidence_id": "e2", "relevant": False, "reason": "r"}],
}


def saying(value, cost=0.25):
    return lambda prompt: (f"Well: ```json\n{json.dumps(value)}\n``` {{so}}", cost)


def render(question, evidence, feedback):
    return f"{question} {len(evidence)} {feedback}"


def test_synthesis_is_judged():
    got, cost = ex.synthesise("q?", EVIDENCE, saying(SAID), render)
    assert cost == 0.25 and got["answer"] == "It is so." and got["relevant"] == 1 and got["suggested_queries"] == ["more"]
    one = SAID["evidence_assessment"][0]
    broken = {
        "EMPTY_ANSWER": {"answer": " "}, "UNKNOWN_CLASSIFICATION": {"classification": "MAYBE"}, "NO_CITATION": {"citation_ids": []}, "UNKNOWN_CITATION": {"citation_ids": ["e9"]},
        "BAD_QUERIES": {"suggested_queries": ["a", "b", "c", "d"]}, "NOT_EXACT_COVER": {"evidence_assessment": [one, one]},
        "BAD_ASSESSMENT": {"evidence_assessment": [one | {"relevant": 1}, one | {"evidence_id": "e2"}]}, "UNSUPPORTED_SCOPE": {"answer": "All sources agree on it."},
    }
    for name, change in broken.items():
        with pytest.raises(Rejected, match=name):
            ex.synthesise("q?", EVIDENCE, saying(SAID | change), render)
    assert ex.synthesis_error(SAID | {"answer": "We do not say that all sources agree."}, ["e1", "e2"]) is None
    with pytest.raises(Rejected, match="NOT_AN_OBJECT"):
        ex.object_in("none {here")
    with pytest.raises(ValueError):
        ex.synthesise(" ", EVIDENCE, saying(SAID), render)


def cases(*names, **more):
    return [{"case_id": n, "question": f"{n}?", "evidence": EVIDENCE, "expected_outcome": "COMPLETED", "required_citation_ids": ["e1"], **more} for n in names]


def task(case):
    return Task(case["case_id"], case["question"], WIDE, rounds=2)


def asking(client):
    return lambda question, evidence, feedback: ex.synthesise(question, evidence, client, render, feedback)


def test_providers_are_compared(spark, tmp_path):
    providers = {"good": ("m1", asking(saying(SAID))), "poor": ("m2", asking(saying(SAID | {"citation_ids": ["e9"]})))}
    report, results = ex.compare_providers(spark, cases("a", "b", forbidden_citation_ids=["e2"]), providers, tmp_path / "x", WIDE, task, repetitions=2)
    good, poor = (report["providers"][p]["summary"] for p in ("good", "poor"))
    assert report["stop_reason"] == "SUITE_COMPLETED" and report["complete"] and results.count() == 8
    assert (good["pass_rate"], good["retries"], good["expected_rate"], good["completeness_accuracy"], good["unsupported_claim_accuracy"]) == (1.0, 0, 1.0, 1.0, 0.0)
    assert good["unsupported_claim_failures"] == ["a", "b"] and good["consistency_rate"] == 1.0 and good["stopping_compliance"] == 1.0
    assert (poor["pass_rate"], poor["escalated"], poor["retries"], poor["completeness_failures"], poor["model_calls"], poor["stopping_compliance"]) == (0.0, 4, 4, ["a", "b"], 8, 1.0)
    stopped, results = ex.compare_providers(spark, cases("a", "b"), providers, tmp_path / "y", Budget(2, 1000, 1000, 1.0), task)
    assert stopped["stop_reason"] == "SUITE_BUDGET_EXHAUSTED" and not stopped["same_cases"] and results.count() == 2 and set(stopped["providers"]) == {"good"}
    with pytest.raises(ValueError):
        ex.compare_providers(spark, cases("a"), {"good": providers["good"]}, tmp_path, WIDE, task)


def test_suites_stop_at_their_cost_and_resume(spark, tmp_path):
    client = ex.Metered(saying(SAID))
    run = lambda cost, **more: ex.run_suite(spark, cases("a", "b", "c"), asking(client), tmp_path, "m", cost, task, **more)
    first, rows = run(0.5)
    assert (first["suite_stop_reason"], first["completed_tasks"], first["total_tasks"], client.calls) == ("SUITE_COST_BUDGET_EXHAUSTED", 2, 3, 2) and rows.count() == 2
    then, rows = run(5.0)
    assert (then["suite_stop_reason"], then["completed_tasks"], then["total_cost_usd"], client.calls) == ("SUITE_COMPLETE", 3, 0.75, 3)
    assert [r["case_id"] for r in then["results"]] == ["a", "b", "c"] and run(5.0)[0]["completed_tasks"] == 3 and client.calls == 3
    assert run(5.0, version="2")[0]["completed_tasks"] == 3 and client.calls == 6 and client.cost == 1.5
    with pytest.raises(ValueError):
        ex.run_suite(spark, [{"case_id": "a", "question": "q"}], asking(client), tmp_path, "m", 1.0, task)


def test_triggers_are_measured_until_refused(spark, tmp_path):
    thin = {"classification": "INSUFFICIENT_EVIDENCE", "relevant": 0, "suggested_queries": ["more"]}

    def answer(client):
        def run(question, evidence):
            client("p")
            return thin if len(evidence) < 3 else {"classification": "SUPPORTED", "relevant": 3, "suggested_queries": []}

        return run

    rows = ex.measure_triggers(spark, cases("a", "b"), saying(SAID), answer, lambda q: [{"evidence_id": "e3"}], tmp_path, 100.0, repetitions=2).orderBy("case_id", "repetition").collect()
    assert [(r.case_id, r.repetition, r.rounds, r.classification, r.expanded, r.stop_reason, r.calls, r.cost_usd) for r in rows][0] == ("a", 1, 2, "INSUFFICIENT_EVIDENCE", True, "QUALITY_GATE_PASSED", 2, 0.5)
    assert len(rows) == 4 and json.loads((tmp_path / "b-rep-2.json").read_text())["trace"]["stop"] == "QUALITY_GATE_PASSED"
    assert ex.measure_triggers(spark, cases("a", "b"), saying(SAID), answer, lambda q: [], tmp_path, 0.25, repetitions=2).count() == 1

    def refuse(prompt):
        raise ProviderError("401")

    refused = ex.measure_triggers(spark, cases("a", "b"), refuse, answer, lambda q: [], tmp_path, 100.0).collect()
    assert [(r.rounds, r.error, r.calls) for r in refused] == [(0, "ProviderError: 401", 1)]


def test_claims_are_drafted_and_checked(spark):
    claims = [
        {"claim": "c1", "verdict": "PROVEN", "evidence_id": "e1", "quote": "Tools are Evaluated"}, {"claim": "c2", "verdict": "proven", "evidence_id": "e1", "quote": "tools are"},
        {"claim": "c3", "verdict": "not_proven", "evidence_id": "e9", "quote": "b"},
    ]
    trace = {"question": "q", "attempts": [{"answer": SAID}, {"answer": None}], "evidence": EVIDENCE}
    got = ex.draft_claims(spark, trace, saying({"claims": claims}), lambda *parts: "p", "m")["claims"]
    assert [(c["claim"], c["verdict"], c["quote_valid"], c["flag"]) for c in got] == [("c1", "proven", True, None), ("c2", "unclear", False, "quote_not_found_in_evidence_snippet"), ("c3", "unclear", False, "unknown_evidence_id")]
    for bad in ({"claims": "none"}, {"claims": [claims[0] | {"verdict": "sure"}]}, {"claims": [claims[0] | {"quote": " "}]}):
        with pytest.raises(Rejected):
            ex.draft_claims(spark, trace, saying(bad), lambda *parts: "p", "m")
    with pytest.raises(ValueError):
        ex.draft_claims(spark, trace | {"evidence": []}, saying({"claims": claims}), lambda *parts: "p", "m")


def test_audits_are_blind_and_held_to_their_cards(spark):
    quote = "array<struct<claim_component: string, quote: string>>"
    rows = [(str(i), "HIGH" if i % 3 else "LOW", f"claim {i}", "secret reason", [("whole", f"Quote {i}.")]) for i in range(12)]
    assessments = spark.createDataFrame(rows, f"evidence_id string, label string, claimed_change string, reason string, supporting_evidence {quote}")
    items = spark.createDataFrame([(str(i), f"before quote {i}. after") for i in range(12)], "evidence_id string, text string")
    cards = ex.audit_cards(assessments, items, ("HIGH", "LOW"), size=6)
    held = cards.collect()
    assert set(cards.columns) & {"label", "reason"} == set() and sum(int(c.audit_id) % 3 == 0 for c in held) == 3 == len(held) - 3
    assert all(c.evidence[0]["at"]["passage"] == f"quote {c.audit_id}." and c.evidence[0]["at"]["context_before"] == "before" for c in held)
    assert [c.audit_id for c in ex.audit_cards(assessments.repartition(7), items, ("HIGH", "LOW"), size=6).collect()] == [c.audit_id for c in held]
    columns = "audit_id string, claim_sha256 string, evidence_sha256 string, scope string, support string, label string, rationale string"
    good = [(c.audit_id, c.claim_sha256, c.evidence_sha256, "IN_SCOPE", "SUPPORTED", "HIGH", "why") for c in held]
    good[0] = (*good[0][:3], "OUT_OF_SCOPE", None, None, "why")
    report = ex.audit_report(cards, spark.createDataFrame(good, columns), assessments)
    high = sum(int(c.audit_id) % 3 > 0 for c in held[1:])
    assert (report["cards"], report["decided"], report["in_scope"], report["support_rate"], report["match_rate"]) == (6, 6, 5, 1.0, round(high / 5, 4))
    bad = [("99", *good[1][1:]), (good[1][0], "x", *good[1][2:]), good[2], good[2], (*good[3][:6], " "), (*good[4][:5], None, "why")]
    errors = {r.audit_id: r.error for r in ex.decision_errors(cards, spark.createDataFrame(bad, columns)).collect()}
    assert errors == {"99": "UNKNOWN_CARD", good[1][0]: "CARD_CHANGED", good[2][0]: "DECIDED_TWICE", good[3][0]: "NO_RATIONALE", good[4][0]: "IN_SCOPE_WITHOUT_LABEL"}
    with pytest.raises(ValueError):
        ex.audit_report(cards, spark.createDataFrame(bad, columns), assessments)
    for wrong in (assessments.union(assessments), assessments.withColumn("label", assessments.reason)):
        with pytest.raises(ValueError):
            ex.audit_cards(wrong, items, ("HIGH", "LOW"), size=6)
    with pytest.raises(ValueError):
        ex.audit_cards(assessments, items.limit(1), ("HIGH", "LOW"), size=6)


def test_a_failed_source_costs_no_other(spark, tmp_path):
    def collect(source):
        yield {"content_id": f"{source['source_key']}-1", "size": 1}
        if source["source_key"] == "bad":
            raise TimeoutError("gone")
        yield {"content_id": f"{source['source_key']}-2"}

    sources = spark.createDataFrame([("x", "a"), ("x", "bad"), ("y", "c")], "platform string, source_key string")
    records, failures = ex.ingest(sources, collect, "content_id string, size long", ("platform", "source_key"), str(tmp_path / "run"))
    assert sorted((r.source_key, r.content_id, r["size"]) for r in records.collect()) == [("a", "a-1", 1), ("a", "a-2", None), ("bad", "bad-1", 1), ("c", "c-1", 1), ("c", "c-2", None)]
    assert [tuple(r) for r in failures.collect()] == [("x", "bad", "TimeoutError: gone")]


def test_settings(tmp_path, monkeypatch):
    values = {"count": 7, "page": 50, "positive": 0.5, "price": 0, "share": 0.8, "flag": False, "text": "t"}
    good = {section: {name: values[kind] for name, kind in rules.items()} for section, rules in settings.RULES.items()}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(good))
    assert settings.read_parameters(path) == good
    good["agent"]["max_rounds"], good["x"]["include_replies"], good["ingestion"]["default_window_days"] = True, 1, 8
    del good["digest"]
    path.write_text(json.dumps(good))
    with pytest.raises(ValueError) as told:
        settings.read_parameters(path)
    assert all(part in str(told.value) for part in ("agent.max_rounds: count", "x.include_replies: flag", "digest: object", "default_window_days: at most"))
    env = tmp_path / ".env"
    env.write_text("# no\nexport LB_A=\"one two\"\nLB_B = 'x\nLB_C=3=4\n2X=5\nnothing\nLB_D=\n")
    monkeypatch.setenv("LB_C", "kept")
    for name in ("LB_A", "LB_B", "LB_D"):
        monkeypatch.setenv(name, "")  # so that they are put back after the test
        monkeypatch.delenv(name)
    assert settings.read_env(env) and [os.environ.get(n) for n in ("LB_A", "LB_B", "LB_C", "LB_D", "2X")] == ["one two", "'x", "kept", "", None]
    assert settings.read_env(env, override=True) and os.environ["LB_C"] == "3=4" and not settings.read_env(tmp_path / "none")


def test_paging():
    told, waits = [], []

    def request(parameters):
        told.append(parameters)
        if len(told) in (1, 2):
            raise TimeoutError("slow")
        at = int(parameters.get("pageToken", 0))
        return {"items": [at], **({"nextPageToken": str(at + 1)} if at < 2 else {})}

    assert list(paging.pages(request, {"list": "l"}, waits.append)) == [0, 1, 2] and waits == [0.25, 0.5] and told[-1] == {"list": "l", "maxResults": 50, "pageToken": "2"}
    for bad in (lambda p: {"error": "quota"}, lambda p: [], lambda p: {"items": [], "nextPageToken": "t"}):
        with pytest.raises(paging.SourceError):
            list(paging.pages(bad, {}, waits.append))

    def down(parameters):
        raise OSError("down")

    with pytest.raises(paging.SourceError, match="3 tries"):
        paging.answered(down, {}, waits.append)
    sizes = []
    look = lambda p: sizes.append(p["ids"].count(",") + 1) or {"data": p["ids"].split(",")}
    ids = [str(i) for i in range(250)]
    assert list(paging.looked_up(look, [*ids, "0"])) == ids and sizes == [100, 100, 50]
    known = {"a": "1"}
    assert paging.user_id("@A", known, {}.get) == "1" and paging.user_id("b", known, {"b": "2"}.get) == "2" and known["b"] == "2"
    with pytest.raises(paging.SourceError):
        paging.remember("a", "3", known)
    with pytest.raises(paging.SourceError):
        paging.user_id("c", known, {}.get)
