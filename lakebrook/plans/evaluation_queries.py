"""Queries of the evaluation analytics: usage, suites, arms, agreement, audits, budgets, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, validation
from ..operators import evaluation as ev
from .entities import Registry, attempts, evidence, table, tasks, with_

q = Registry()
USAGE = "count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(latency_seconds), 3) AS latency, round(sum(output_tokens) / nullif(CAST(sum(latency_seconds) AS DOUBLE), 0), 3) AS tokens_per_second, round(CAST(sum(output_tokens) AS DOUBLE) / count(*), 3) AS mean_tokens"


@q("usage_totals", with_("attempts") + f"SELECT {USAGE} FROM attempts")
def usage_totals(spark, d):
    return ev.usage_totals(attempts(spark, d))


@q("provider_timing", with_("attempts") + f"SELECT provider, {USAGE} FROM attempts GROUP BY provider")
def provider_timing(spark, d):
    return ev.usage_totals(attempts(spark, d), "provider")


@q("latency_summary", with_("attempts") + "SELECT provider, round(sum(latency_seconds), 3) AS total, round(coalesce(sum(latency_seconds) FILTER (WHERE flag = 'R'), 0), 3) AS rejected, count(*) FILTER (WHERE flag = 'R') AS rejected_calls FROM attempts GROUP BY provider")
def latency_summary(spark, d):
    bad = F.col("flag") == "R"
    return attempts(spark, d).groupBy("provider").agg(F.round(F.sum("latency_seconds"), 3).alias("total"), F.round(F.sum(F.when(bad, F.col("latency_seconds")).otherwise(0.0)), 3).alias("rejected"), F.count_if(bad).alias("rejected_calls"))


LABELS_SQL = "SELECT label, coalesce(n, 0) AS n FROM (VALUES ('good'), ('bad'), ('unclear')) v(label) LEFT JOIN (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, count(*) AS n FROM labels GROUP BY 1) USING (label)"


@q("label_counts", LABELS_SQL)
def label_counts(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return ev.zero_filled(rows, "label", ("good", "bad", "unclear"))


@q("source_counts", "SELECT coalesce(source, lang, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, d):
    key = F.coalesce("source", "lang", F.lit("unknown")).alias("source")
    return table(spark, d, "documents").groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source")


@q("top_sources", "WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source) SELECT source, n, (SELECT count(*) FROM c) - 4 AS more FROM c WHERE r <= 4")
def top_sources(spark, d):
    counts = source_counts(spark, d)
    return counts.limit(4).crossJoin(counts.agg((F.count("*") - 4).alias("more")))  # one row


SUITE = with_("attempts", "tasks") + """, last AS (SELECT task_id, max_by(flag, (round, provider, item_id)) AS flag, count(*) AS rounds, sum(cost_usd) AS cost FROM attempts GROUP BY task_id),
 r AS (SELECT t.case_id, t.outcome, l.* FROM tasks t JOIN last l USING (task_id))"""


def _results(spark, d):
    last = attempts(spark, d).groupBy("task_id").agg(F.max_by("flag", F.struct("round", "provider", "item_id")).alias("flag"), F.count("*").alias("rounds"), F.sum("cost_usd").alias("cost_usd"))
    return tasks(spark, d).select("task_id", "case_id", "outcome", "source_id").join(last, "task_id")


@q("suite_summary", SUITE + " SELECT case_id, count(*) AS tasks, round(avg(CASE WHEN flag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) FILTER (WHERE rounds > 1) AS retried, count(*) FILTER (WHERE flag <> 'N') AS escalated, CAST(sum(rounds) AS BIGINT) AS calls, round(sum(cost), 6) AS cost, round(CAST(sum(CASE WHEN flag = 'N' THEN rounds - 1 END) AS DOUBLE) / nullif(count(*) FILTER (WHERE flag = 'N'), 0), 6) AS retries_to_pass, count(DISTINCT outcome) = 1 AS consistent FROM r GROUP BY case_id")
def suite_summary(spark, d):
    ok = F.col("flag") == "N"
    return _results(spark, d).groupBy("case_id").agg(
        F.count("*").alias("tasks"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"), F.count_if(F.col("rounds") > 1).alias("retried"), F.count_if(~ok).alias("escalated"),
        F.sum("rounds").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost"), F.round(F.avg(F.when(ok, F.col("rounds") - 1)), 6).alias("retries_to_pass"), (F.countDistinct("outcome") == 1).alias("consistent"),
    )


@q("critical_failures", with_("attempts") + "SELECT flag || '-' || status AS failure, count(*) AS n FROM attempts WHERE flag <> 'N' GROUP BY 1")
def critical_failures(spark, d):
    nested = attempts(spark, d).where("flag <> 'N'").groupBy("task_id").agg(F.collect_list(F.concat_ws("-", "flag", "status")).alias("failures"))
    return nested.select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


TRIGGER = "CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_type = 'click' THEN 'label' ELSE 'relevance_only' END WHEN event_type = 'signup' THEN 'stopped_label_sufficient' WHEN event_type = 'purchase' THEN 'stopped_no_queries' ELSE 'no_round_one' END"


def classify_trigger_column(rounds, classification, expanded):
    insufficient = classification == "INSUFFICIENT_EVIDENCE"
    return F.when(rounds == 0, "no_round_one").when(expanded & insufficient, "label").when(expanded, "relevance_only").when(insufficient, "stopped_no_queries").otherwise("stopped_label_sufficient")


@q("classify_trigger", f"SELECT event_id, {TRIGGER} AS trigger FROM events")
def classify_trigger(spark, d):
    kind = F.col("event_type")
    label = F.when(kind.isin("click", "purchase"), "INSUFFICIENT_EVIDENCE").otherwise("SUPPORTED")
    return table(spark, d, "events").select("event_id", classify_trigger_column(F.when(kind == "error", 0).otherwise(1), label, kind.isin("click", "view")).alias("trigger"))


@q("trigger_summary", f"SELECT {TRIGGER} AS trigger, count(*) AS runs, round(sum(value), 3) AS latency FROM events GROUP BY 1")
def trigger_summary(spark, d):
    rows = classify_trigger(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id")
    return rows.groupBy("trigger").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 3).alias("latency"))


@q("agreement_report", "SELECT lang AS criterion, count(*) FILTER (WHERE quality = toxic) AS agreed, count(*) FILTER (WHERE quality <> toxic) AS disagreed, count(*) AS total, round(CAST(count(*) FILTER (WHERE quality = toxic) AS DOUBLE) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def agreement_report(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    same = F.count_if(F.col("quality") == F.col("toxic"))
    return both.groupBy(F.col("lang").alias("criterion")).agg(same.alias("agreed"), F.count_if(F.col("quality") != F.col("toxic")).alias("disagreed"), F.count("*").alias("total"), F.coalesce(ev.rate(same, F.count("*")), F.lit(0.0)).alias("rate"))


@q("audit_join", "SELECT l.doc_id, d.source, l.quality AS human, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS model FROM labels l JOIN documents d USING (doc_id) JOIN events e ON e.event_id = l.doc_id")
def audit_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("model"))
    cards = table(spark, d, "events").select(F.col("event_id").alias("doc_id"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("human")).join(docs, "doc_id").join(cards, "doc_id")


@q("audit_report", "WITH a AS (SELECT l.quality AS human, l.toxic, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS model FROM labels l JOIN documents d USING (doc_id)) SELECT count(*) AS cards, count(*) FILTER (WHERE toxic = 0) AS in_scope, round(CAST(count(*) FILTER (WHERE toxic = 0 AND human = model) AS DOUBLE) / nullif(count(*) FILTER (WHERE toxic = 0), 0), 6) AS match_rate, round(CAST(count(*) FILTER (WHERE human = 1) AS DOUBLE) / count(*), 6) AS accepted_rate FROM a")
def audit_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("model"))
    a = table(spark, d, "labels").join(docs, "doc_id")
    scope = F.col("toxic") == 0
    return a.agg(F.count("*").alias("cards"), F.count_if(scope).alias("in_scope"), ev.rate(F.count_if(scope & (F.col("quality") == F.col("model"))), F.count_if(scope)).alias("match_rate"), ev.rate(F.count_if(F.col("quality") == 1), F.count("*")).alias("accepted_rate"))


@q("completeness_check", "SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'unexpected' ELSE 'missing' END AS problem FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def completeness_check(spark, d):
    """All documents against all labels."""
    packet = table(spark, d, "documents").select(F.col("doc_id").alias("p"))
    review = table(spark, d, "labels").select(F.col("doc_id").alias("r"))
    both = packet.join(review, F.col("p") == F.col("r"), "full_outer").where("p is null or r is null")
    return both.select(F.coalesce("r", "p").alias("id"), F.when(F.col("p").isNull(), "unexpected").otherwise("missing").alias("problem"))


@q("label_join", "SELECT e.event_id, e.event_type, l.quality FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id")
def label_join(spark, d):
    responses = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), "quality").dropDuplicates(["event_id"])
    return table(spark, d, "events").select("event_id", "event_type").join(responses, "event_id", "left")


@q("corpus_profile", "SELECT lang AS platform, count(DISTINCT source) AS sources, count(*) AS items, count(*) FILTER (WHERE n_chars > 1000) AS transcripts FROM documents GROUP BY lang")
def corpus_profile(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("platform")).agg(F.countDistinct("source").alias("sources"), F.count("*").alias("items"), F.count_if(F.col("n_chars") > 1000).alias("transcripts"))


ARMS = "arms AS (SELECT o_orderpriority || '/' || (o_custkey % 300) AS case_id, o_orderkey % 2 AS arm, o_orderstatus <> 'P' AS ok FROM orders), s AS (SELECT case_id, arm, min(ok) AS lo, max(ok) AS hi, count(*) FILTER (WHERE ok) AS matches, count(*) AS n FROM (SELECT case_id, arm, ok FROM arms) GROUP BY case_id, arm), j AS (SELECT case_id, a.lo AS al, a.hi AS ah, b.lo AS bl, b.hi AS bh, a.matches AS a_matches, b.matches AS b_matches, a.n AS an, b.n AS bn FROM (SELECT * FROM s WHERE arm = 0) a JOIN (SELECT * FROM s WHERE arm = 1) b USING (case_id))"
ROLE = "CASE WHEN al <> ah OR bl <> bh THEN 'noise' WHEN al AND bl THEN 'saturated_pass' WHEN NOT al AND NOT bl THEN 'saturated_fail' ELSE 'discriminating' END"


def _arms(spark, d):
    rows = table(spark, d, "orders").select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 300).cast("string")).alias("case_id"), (F.col("o_orderkey") % 2).alias("arm"), (F.col("o_orderstatus") != "P").alias("ok"))
    s = rows.groupBy("case_id", "arm").agg(F.min("ok").alias("lo"), F.max("ok").alias("hi"), F.count_if("ok").alias("matches"), F.count("*").alias("n"))
    side = lambda k, p: s.where(F.col("arm") == k).select("case_id", *[F.col(c).alias(p + c) for c in ("lo", "hi", "matches", "n")])
    return side(0, "a_"), side(1, "b_")


@q("arm_compare", f"WITH {ARMS} SELECT case_id, {ROLE} AS role, a_matches, b_matches FROM j")
def arm_compare(spark, d):
    a, b = _arms(spark, d)
    return a.join(b, "case_id").select("case_id", ev.role(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")).alias("role"), "a_matches", "b_matches")


@q("arm_roles", f"WITH {ARMS} SELECT {ROLE} AS role, count(*) AS cases, CAST(sum(a_matches) AS BIGINT) AS a_matches, CAST(sum(b_matches) AS BIGINT) AS b_matches FROM j GROUP BY 1")
def arm_roles(spark, d):
    return arm_compare(spark, d).groupBy("role").agg(F.count("*").alias("cases"), F.sum("a_matches").alias("a_matches"), F.sum("b_matches").alias("b_matches"))


@q("uniformity_guard", "SELECT o_orderpriority AS arm, count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT year(o_orderdate)) = 1 AS uniform, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1")
def uniformity_guard(spark, d):
    return tasks(spark, d).groupBy(F.col("case_id").alias("arm")).agg(((F.countDistinct("outcome") == 1) & (F.countDistinct(F.year("published_at")) == 1)).alias("uniform"), F.countDistinct("outcome").alias("statuses"))


@q("suite_counts", "SELECT o_orderpriority AS split, count(*) AS cases, count(DISTINCT o_custkey) AS refs, count(*) FILTER (WHERE o_orderstatus = 'F') AS reviewed FROM orders GROUP BY 1")
def suite_counts(spark, d):
    return tasks(spark, d).groupBy(F.col("case_id").alias("split")).agg(F.count("*").alias("cases"), F.countDistinct("source_id").alias("refs"), F.count_if(F.col("outcome") == "F").alias("reviewed"))


@q("digest_estimate", "SELECT count(*) AS n, count(*) FILTER (WHERE length(text) = 0) AS empties, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, list_sort(list(length(text)))[count(*) // 2 + 1] AS upper_median, max(length(text)) AS longest FROM documents")
def digest_estimate(spark, d):
    """The upper median comes from a histogram of lengths, so that no list of all rows is built."""
    size = table(spark, d, "documents").select(F.length("text").cast("long").alias("n"))
    by = size.groupBy("n").agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy("n")))  # distinct lengths only
    one = size.agg(F.count("*").alias("n"), F.count_if(F.col("n") == 0).alias("empties"), F.sum("n").alias("chars"), F.sum(F.floor(F.col("n") / 4)).cast("long").alias("tokens"), F.max("n").alias("longest"))
    median = upto.join(one.select(F.expr("n div 2 + 1").alias("place")), F.col("upto") >= F.col("place")).agg(F.min("n").alias("upper_median"))
    return one.crossJoin(median)


@q("ingest_totals", with_("attempts") + "SELECT count(*) AS attempts, count(DISTINCT provider) AS sources, count(*) FILTER (WHERE flag = 'R') AS failed, CAST(sum(output_tokens) AS BIGINT) AS items FROM attempts")
def ingest_totals(spark, d):
    return attempts(spark, d).agg(F.count("*").alias("attempts"), F.countDistinct("provider").alias("sources"), F.count_if(F.col("flag") == "R").alias("failed"), F.sum("output_tokens").alias("items"))


@q("api_cost", with_("attempts") + "SELECT provider, round(CAST(sum(output_tokens) AS DOUBLE) * 0.005 + count(*) * 0.01, 6) AS cost FROM attempts GROUP BY provider")
def api_cost(spark, d):
    return attempts(spark, d).groupBy("provider").agg(F.round(F.sum("output_tokens").cast("double") * 0.005 + F.count("*") * 0.01, 6).alias("cost"))


@q("usage_cost", with_("attempts") + "SELECT task_id, round, provider, item_id, round((output_tokens * 3.0 + round * 15.0) / 1000000, 8) AS cost, round(output_tokens / nullif(latency_seconds, 0), 6) AS tokens_per_second FROM attempts")
def usage_cost(spark, d):
    a = attempts(spark, d)
    return a.select("task_id", "round", "provider", "item_id", validation.call_cost(F.col("output_tokens"), F.col("round"), 3.0, 15.0).alias("cost"), F.round(F.col("output_tokens") / F.nullif("latency_seconds", F.lit(0.0)), 6).alias("tokens_per_second"))


@q("fitted_budget", with_("attempts") + "SELECT task_id, CAST(least(greatest(ceil((count(*) + 1) / 0.8), 3), 7) AS BIGINT) AS calls FROM attempts GROUP BY task_id")
def fitted_budget(spark, d):
    return attempts(spark, d).groupBy("task_id").agg(F.count("*").alias("n")).select("task_id", validation.fitted_calls(F.col("n"), 0.8, 3, 7).cast("long").alias("calls"))


@q("relevant_count", with_("attempts") + "SELECT task_id, count(*) FILTER (WHERE flag = 'N') AS relevant, count(*) FILTER (WHERE flag = 'N') < least(3, count(*)) AS thin FROM attempts GROUP BY task_id")
def relevant_count(spark, d):
    nested = attempts(spark, d).groupBy("task_id").agg(F.collect_list(F.struct((F.col("flag") == "N").alias("relevant"))).alias("evidence"))
    relevant = F.size(F.filter("evidence", lambda e: e["relevant"])).cast("long")
    return nested.select("task_id", relevant.alias("relevant"), (relevant < F.least(F.lit(3), F.size("evidence"))).alias("thin"))


@q("thin_evidence", with_("attempts") + "SELECT task_id FROM attempts GROUP BY task_id HAVING count(*) FILTER (WHERE flag = 'N') < least(3, count(*))")
def thin_evidence(spark, d):
    return relevant_count(spark, d).where("thin").select("task_id")


@q("quality_gate", with_("attempts") + "SELECT task_id, round(avg(CASE WHEN flag <> 'R' THEN 1.0 ELSE 0.0 END), 6) AS pass_fraction, coalesce(string_agg(CAST(provider AS VARCHAR), ',' ORDER BY CAST(provider AS VARCHAR)) FILTER (WHERE flag = 'R'), '') AS failed, coalesce(string_agg(CAST(provider AS VARCHAR), ',' ORDER BY CAST(provider AS VARCHAR)) FILTER (WHERE flag = 'R' AND status = 'F'), '') AS critical_failures, CASE WHEN count(*) FILTER (WHERE flag = 'R' AND status = 'F') > 0 THEN 'CRITICAL_FAILURE' WHEN avg(CASE WHEN flag <> 'R' THEN 1.0 ELSE 0.0 END) < 0.8 THEN 'BELOW_THRESHOLD' ELSE 'PASSED' END AS reason FROM attempts GROUP BY task_id")
def quality_gate(spark, d):
    checks = attempts(spark, d).select("task_id", F.col("provider").cast("string").alias("name"), (F.col("flag") != "R").alias("passed"), (F.col("status") == "F").alias("critical"))
    return ev.quality_gate(checks, "task_id", "name", "passed", "critical", 0.8)


@q("stratified_alloc", "WITH c AS (SELECT label, n FROM (" + LABELS_SQL + ") WHERE n > 0), l AS (SELECT max(g) AS level FROM range(21) r(g) WHERE (SELECT sum(least(n, g)) FROM c) <= 20), a AS (SELECT label, n, level, row_number() OVER (PARTITION BY n > level ORDER BY CASE label WHEN 'good' THEN 0 WHEN 'bad' THEN 1 ELSE 2 END) AS place, (SELECT sum(least(n, level)) FROM c) AS filled FROM c, l) SELECT label, CAST(least(n, level) + CASE WHEN n > level AND place <= 20 - filled THEN 1 ELSE 0 END AS BIGINT) AS n FROM a")
def stratified_alloc(spark, d):
    counts = {r["label"]: r["n"] for r in label_counts(spark, d).collect()}  # three rows
    return spark.createDataFrame(list(ev.allocations(counts, 20, ("good", "bad", "unclear")).items()), "label string, n long")


@q("stratified_sample", "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('audit:' || doc_id), doc_id) AS n FROM labels) WHERE n <= 10")
def stratified_sample(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality", F.col("quality").cast("string").alias("label"))
    return ev.stratified_sample(rows, "label", "doc_id", {"0": 10, "1": 10}, "audit").select("doc_id", "quality")


@q("last_attempt", with_("attempts") + "SELECT task_id, max_by(flag, (round, provider, item_id)) AS last_flag, min_by(flag, (round, provider, item_id)) AS first_flag FROM attempts GROUP BY task_id")
def last_attempt(spark, d):
    key = F.struct("round", "provider", "item_id")
    return attempts(spark, d).groupBy("task_id").agg(F.max_by("flag", key).alias("last_flag"), F.min_by("flag", key).alias("first_flag"))


@q("budget_cutoff", "SELECT o_custkey AS source_id, o_orderkey AS task_id, round(spent, 6) AS spent_before FROM (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders) WHERE round(spent, 6) < 800000")
def budget_cutoff(spark, d):
    return ev.within_budget(tasks(spark, d), "source_id", "task_id", "cost", 800000.0).select("source_id", "task_id", "spent_before")


@q("capped_merge", with_("attempts") + "SELECT task_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY kind, round, item_id) AS place FROM (SELECT task_id, item_id, CASE flag WHEN 'N' THEN 0 ELSE 1 END AS kind, round, row_number() OVER (PARTITION BY task_id, item_id ORDER BY CASE flag WHEN 'N' THEN 0 ELSE 1 END, round) AS f FROM attempts) WHERE f = 1) WHERE place <= 3 OR kind = 0")
def capped_merge(spark, d):
    rows = attempts(spark, d).select("task_id", "item_id", F.when(F.col("flag") == "N", 0).otherwise(1).alias("kind"), "round")
    return ev.capped_merge(rows, "task_id", "item_id", "kind", "round", 3).select("task_id", "item_id", "place")


@q("take_while", "SELECT o_custkey AS source_id, o_orderkey AS task_id FROM (SELECT *, max(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM orders) WHERE b = 0")
def take_while(spark, d):
    newest = [F.col("published_at").desc(), F.col("task_id").desc()]
    return ev.take_while(tasks(spark, d), "source_id", newest, F.col("published_at") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("source_id", "task_id")


@q("moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_avg(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@q("ranked_digest", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END, coalesce(strftime(ts, '%Y-%m-%d'), ''), doc_id) AS place FROM documents LEFT JOIN events ON event_id = doc_id")
def ranked_digest(spark, d):
    """Label priority, unknown labels last; then the publication text; then the id."""
    priority = F.when(F.col("source_key") == "src1", 0).when(F.col("source_key") == "src2", 1).when(F.col("source_key") == "src3", 2).otherwise(3)
    w = Window.partitionBy("platform").orderBy(priority, F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")), "evidence_id")
    return evidence(spark, d).select(F.col("evidence_id").alias("doc_id"), F.row_number().over(w).cast("long").alias("place"))


@q("refusal_flag", "SELECT conv_id, turn, contains(lower(text), 'ent') OR contains(lower(text), 'quota') AS refused FROM conversations")
def refusal_flag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike("ent|quota").alias("refused"))


IDS = "a AS (SELECT l_orderkey AS task_id, list_distinct(list(l_partkey)) AS cited, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag <> 'R')) AS allowed, list(l_partkey) FILTER (WHERE l_linestatus = 'F') AS assessed FROM lineitem GROUP BY 1)"


def _citations(spark, d):
    item = F.col("l_partkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.collect_set(item).alias("cited"), F.collect_set(F.when(F.col("l_returnflag") != "R", item)).alias("allowed"), F.collect_list(F.when(F.col("l_linestatus") == "F", item)).alias("assessed"),
    )


@q("unknown_citations", f"WITH {IDS} SELECT task_id, len(list_filter(cited, lambda x: NOT list_contains(coalesce(allowed, []), x))) AS unknown FROM a")
def unknown_citations(spark, d):
    return _citations(spark, d).select("task_id", F.size(F.array_except("cited", "allowed")).cast("long").alias("unknown"))


@q("exact_cover", f"WITH {IDS} SELECT task_id, list_sort(coalesce(assessed, [])) = list_sort(coalesce(allowed, [])) AS exact FROM a")
def exact_cover(spark, d):
    return _citations(spark, d).select("task_id", (F.array_sort("assessed") == F.array_sort("allowed")).alias("exact"))


@q("citation_rules", f"WITH {IDS} SELECT task_id, len(list_filter(coalesce(allowed, []), lambda x: NOT list_contains(coalesce(assessed, []), x))) = 0 AS required_met, len(list_filter(coalesce(assessed, []), lambda x: x % 7 = 0)) > 0 AS forbidden_hit FROM a")
def citation_rules(spark, d):
    forbidden = F.filter("cited", lambda x: x % 7 == 0)
    return _citations(spark, d).select("task_id", (F.size(F.array_except("allowed", "assessed")) == 0).alias("required_met"), F.arrays_overlap("assessed", forbidden).alias("forbidden_hit"))


@q("validate_answer", f"WITH {IDS} SELECT task_id, CASE WHEN len(cited) = 0 THEN 'NO_CITATION' WHEN len(list_filter(cited, lambda x: NOT list_contains(coalesce(allowed, []), x))) > 0 THEN 'UNKNOWN_CITATION' WHEN list_sort(coalesce(assessed, [])) <> list_sort(coalesce(allowed, [])) THEN 'NOT_EXACT_COVER' END AS error FROM a")
def validate_answer(spark, d):
    return _citations(spark, d).select("task_id", validation.answer_error(F.col("cited"), F.col("allowed"), F.col("assessed")).alias("error"))


def _raw(spark, d):
    """Model output in every shape: bare, fenced, in prose, malformed, with a wrong key, an unknown label or a false quote."""
    kind = F.col("doc_id") % 7
    quote = F.when(kind == 5, "Nowhere in it at all").otherwise(F.substring("text", 1, 20))
    label = F.when(kind == 4, "HUGE").otherwise("significant")
    body = F.to_json(F.struct(F.lit("c").alias("claimed_change"), F.lit("p").alias("problem_addressed"), label.alias("significance"), F.lit("r").alias("reason"), F.array(F.struct(F.lit("x").alias("claim_component"), quote.alias("quote"))).alias("supporting_evidence")))
    raw = F.when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("It is "), body, F.lit(" so."))).when(kind == 3, F.lit("no object")).when(kind == 6, F.lit('{"claimed_change": "c"}')).otherwise(body)
    return table(spark, d, "documents").select("doc_id", "text", raw.alias("raw"))


@q("parse_model_json", "SELECT doc_id, doc_id % 7 <> 3 AS parsed FROM documents")
def parse_model_json(spark, d):
    return _raw(spark, d).select("doc_id", text.extract_json_object(F.col("raw")).isNotNull().alias("parsed"))


@q("validate_assessment", "SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN 'NOT_AN_OBJECT' WHEN 6 THEN 'WRONG_KEYS' WHEN 4 THEN 'UNKNOWN_LABEL' WHEN 5 THEN 'UNGROUNDED_QUOTE' END AS error FROM documents")
def validate_assessment(spark, d):
    return _raw(spark, d).select("doc_id", validation.assessment_error(text.extract_json_object(F.col("raw")), F.col("text")).alias("error"))


@q("claim_downgrade", "SELECT doc_id, quality = 1 AND toxic = 1 AS downgraded, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict FROM labels")
def claim_downgrade(spark, d):
    """A claimed support without a grounded quote becomes unsupported, and says so."""
    claimed, is_grounded = F.col("quality") == 1, F.col("toxic") == 0
    return table(spark, d, "labels").select("doc_id", (claimed & ~is_grounded).alias("downgraded"), F.when(claimed & is_grounded, "SUPPORTED").otherwise("NOT_SUPPORTED").alias("verdict"))


@q("label_rules", "SELECT event_id, CASE event_type WHEN 'error' THEN 'SCOPE_MISSING' WHEN 'click' THEN 'OUT_OF_SCOPE_WITH_VERDICT' WHEN 'view' THEN 'IN_SCOPE_WITHOUT_SUPPORT' WHEN 'signup' THEN 'IN_SCOPE_WITHOUT_LABEL' END AS broken FROM events")
def label_rules(spark, d):
    kind = F.col("event_type")
    scope = F.when(kind == "click", "OUT_OF_SCOPE").when(kind != "error", "IN_SCOPE")
    support, label = F.when(kind.isin("click", "signup", "purchase"), "FULL"), F.when(kind.isin("view", "purchase"), "HIGH")
    return table(spark, d, "events").select("event_id", validation.decision_error(scope, support, label).alias("broken"))


@q("suite_violations", "SELECT o_orderkey AS case_id, rule FROM (SELECT o_orderkey, unnest(['PRICE', 'STATUS', 'URGENT']) AS rule, unnest([o_totalprice < 5000, o_orderstatus = 'P', o_orderpriority = '1-URGENT']) AS broken FROM orders) WHERE broken")
def suite_violations(spark, d):
    """One row for each case and rule that it breaks."""
    rules = {"PRICE": F.col("cost") < 5000, "STATUS": F.col("outcome") == "P", "URGENT": F.col("case_id") == "1-URGENT"}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return tasks(spark, d).select(F.col("task_id"), F.explode(broken).alias("rule")).withColumnRenamed("task_id", "case_id")


@q("spec_violations", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'COST_NOT_POSITIVE' WHEN c_nationkey = 0 THEN 'ROUNDS_NOT_POSITIVE' WHEN c_acctbal / 5000 > 1 THEN 'FRACTION_OUT_OF_RANGE' END AS broken FROM customer")
def spec_violations(spark, d):
    rules = (("COST_NOT_POSITIVE", F.col("c_acctbal") <= 0), ("ROUNDS_NOT_POSITIVE", F.col("c_nationkey") == 0), ("FRACTION_OUT_OF_RANGE", F.col("c_acctbal") / 5000 > 1))
    return table(spark, d, "customer").select("c_custkey", validation.first_broken(*rules).alias("broken"))


@q("stopping_compliance", SUITE + " SELECT task_id, CASE flag WHEN 'N' THEN outcome <> 'P' WHEN 'R' THEN outcome = 'P' ELSE rounds >= 3 END AS compliant FROM r")
def stopping_compliance(spark, d):
    stop, outcome = F.col("flag"), F.col("outcome")
    return _results(spark, d).select("task_id", F.when(stop == "N", outcome != "P").when(stop == "R", outcome == "P").otherwise(F.col("rounds") >= 3).alias("compliant"))


@q("outcome_map", SUITE + " SELECT task_id, CASE WHEN flag = 'N' AND rounds = 1 THEN 'COMPLETED' WHEN flag = 'N' THEN 'COMPLETED_AFTER_RETRY' WHEN flag = 'A' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ESCALATED' END AS mapped, CASE WHEN flag IN ('N', 'A') THEN 0 ELSE 1 END AS exit_code FROM r")
def outcome_map(spark, d):
    flag = F.col("flag")
    mapped = F.when((flag == "N") & (F.col("rounds") == 1), "COMPLETED").when(flag == "N", "COMPLETED_AFTER_RETRY").when(flag == "A", "INSUFFICIENT_EVIDENCE").otherwise("ESCALATED")
    return _results(spark, d).select("task_id", mapped.alias("mapped"), F.when(mapped == "ESCALATED", 1).otherwise(0).alias("exit_code"))


@q("render_prompt", "SELECT item_id, 'Question: ' || text || chr(10) || 'Evidence: ' || item_id AS prompt FROM benchmark")
def render_prompt(spark, d):
    filled = F.replace(F.replace(F.lit("Question: {question}\nEvidence: {evidence}"), F.lit("{evidence}"), F.col("item_id").cast("string")), F.lit("{question}"), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", filled.alias("prompt"))


@q("compat_projection", "SELECT l_orderkey AS task_id, l_linenumber AS round, l_partkey AS item, CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || '|' || l_suppkey END AS quotes FROM lineitem")
def compat_projection(spark, d):
    """Version 1 rows have one quote, version 2 an array: both are read as an array."""
    v1, v2 = F.array(F.col("l_partkey").cast("string")), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    quotes = F.when(F.col("l_linenumber") == 1, v1).otherwise(v2)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("round"), F.col("l_partkey").alias("item"), F.array_join(quotes, "|").alias("quotes"))


@q("render_rows", "SELECT source, string_agg('- ' || doc_id, chr(10) ORDER BY doc_id) AS lines FROM documents GROUP BY source")
def render_rows(spark, d):
    ordered = F.sort_array(F.collect_list("doc_id"))
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.transform(ordered, lambda i: F.concat(F.lit("- "), i.cast("string"))), "\n").alias("lines"))
