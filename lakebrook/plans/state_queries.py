"""Queries of windows, registries, cursors and consistency checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import state, window
from .entities import Registry, attempts, evidence, table, tasks, with_

q = Registry()
SINCE, UNTIL = datetime(2024, 1, 1), datetime(2024, 1, 2)
BETWEEN = "published_at >= TIMESTAMP '2024-01-01' AND published_at < TIMESTAMP '2024-01-02'"
#: Statuses of the registry stand-in, by order number.
STATUS_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'SKIPPED_SHORT_NO_SPEECH' WHEN 2 THEN 'FAILED_DOWNLOAD' WHEN 3 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'PENDING' END"
REGISTRY = f"registry AS (SELECT o_orderkey AS content_id, o_custkey AS source_key, {STATUS_SQL} AS status, o_orderdate AS published_at, o_orderpriority AS url FROM orders)"


def registry(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("content_id"), F.col("o_custkey").alias("source_key"), F.expr(STATUS_SQL).alias("status"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("url"))


@q("scan_evidence", with_("evidence") + "SELECT evidence_id, platform, source_key, 'document' AS kind, published_at, length(text) AS n_chars, sha256(text) AS content_hash FROM evidence WHERE trim(text) <> ''")
def scan_evidence(spark, d):
    return evidence(spark, d).where("trim(text) <> ''").select("evidence_id", "platform", "source_key", F.lit("document").alias("kind"), "published_at", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("content_hash"))


@q("scan_warnings", "SELECT event_id, CASE WHEN doc_id IS NULL THEN 'MISSING_TRANSCRIPT' WHEN length(text) < 60 THEN 'EMPTY_TRANSCRIPT' END AS warning FROM events LEFT JOIN documents ON doc_id = event_id WHERE doc_id IS NULL OR length(text) < 60")
def scan_warnings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.length("text").alias("n"))
    warning = F.when(F.col("n").isNull(), "MISSING_TRANSCRIPT").when(F.col("n") < 60, "EMPTY_TRANSCRIPT")
    return table(spark, d, "events").select("event_id").join(docs, "event_id", "left").select("event_id", warning.alias("warning")).where("warning is not null")


@q("union_sources", "SELECT 'documents' AS adapter, doc_id AS content_id, length(text) AS n FROM documents UNION ALL SELECT 'pages', page_id, length(html) FROM pages")
def union_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("adapter"), F.col("doc_id").alias("content_id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(table(spark, d, "pages").select(F.lit("pages").alias("adapter"), F.col("page_id").alias("content_id"), F.length("html").cast("long").alias("n")))


@q("window_select", with_("evidence") + f"SELECT evidence_id, platform, published_at FROM evidence WHERE {BETWEEN}")
def window_select(spark, d):
    return window.select_window(evidence(spark, d), SINCE, UNTIL).select("evidence_id", "platform", "published_at").orderBy("published_at", "evidence_id")


@q("window_platform", with_("evidence") + f"SELECT evidence_id, platform FROM evidence WHERE {BETWEEN} AND lower(trim(platform)) IN ('en', 'de')")
def window_platform(spark, d):
    return window.select_window(evidence(spark, d), SINCE, UNTIL, [" EN ", "de"]).select("evidence_id", "platform")


@q("window_counters", with_("evidence") + f"SELECT count(*) AS considered, count(*) FILTER (WHERE {BETWEEN}) AS selected, count(*) FILTER (WHERE published_at IS NULL) AS unparseable FROM evidence")
def window_counters(spark, d):
    return window.window_counters(evidence(spark, d), SINCE, UNTIL)


@q("excluded_counts", r"SELECT count(*) AS selected, count(*) FILTER (WHERE NOT ok) AS excluded FROM (SELECT regexp_matches(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '[MUSIC PLAYING] ...' ELSE text END, '\[[^\[\]]+\]', ' ', 'g'), '[\p{L}\p{N}]') AS ok FROM documents)")
def excluded_counts(spark, d):
    items = table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, "[MUSIC PLAYING] ...").otherwise(F.col("text")).alias("text"))
    return items.agg(F.count("*").alias("selected"), F.count_if(~window.is_substantive(F.col("text"))).alias("excluded"))


@q("semi_filter", r"SELECT d.doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_filter(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@q("clamped_window", "SELECT o_orderkey AS task_id, greatest(o_orderdate - INTERVAL 400 DAY, TIMESTAMP '1998-06-01' - INTERVAL 180 DAY) AS since, o_orderdate - INTERVAL 400 DAY < TIMESTAMP '1998-06-01' - INTERVAL 180 DAY AS clamped FROM orders")
def clamped_window(spark, d):
    asked, until = F.col("o_orderdate") - F.expr("interval 400 days"), F.lit(datetime(1998, 6, 1)).cast("timestamp_ntz")
    since = times.clamp_since(asked, until, 180)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), since.alias("since"), (asked < since).alias("clamped"))


@q("window_days", "SELECT o_orderkey AS task_id, round(greatest(date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate) / 86400000000.0, 1.0), 3) AS days FROM orders")
def window_days(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), times.window_days(F.lit("1995-01-01").cast("timestamp"), F.col("o_orderdate")).alias("days"))


@q("tumbling_window", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start_at, count(*) AS n FROM events GROUP BY 1")
def tumbling_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "n")


@q("sliding_window", "SELECT s AS start_at, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s")
def sliding_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "n")


@q("session_window", "SELECT user_id, min(ts) AS start_at, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_window(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_at"), "n")


@q("terminal_content", f"WITH {REGISTRY} SELECT content_id FROM registry WHERE status IN ('COMPLETED', 'SKIPPED_SHORT_NO_SPEECH')")
def terminal_content(spark, d):
    return registry(spark, d).where(state.is_terminal(F.col("status"))).select("content_id")


@q("status_category", f"WITH {REGISTRY} SELECT content_id, CASE WHEN starts_with(status, 'FAILED') OR status = 'COMPLETED_WITH_FAILURES' THEN 'FAILURE' WHEN starts_with(status, 'SKIPPED_') OR status = 'COMPLETED_WITH_WARNINGS' THEN 'WARNING' ELSE 'INFO' END AS category FROM registry")
def status_category(spark, d):
    return registry(spark, d).select("content_id", state.status_category(F.col("status")).alias("category"))


CURSOR = "cursors AS (SELECT source_key, max(CASE WHEN status IN ('COMPLETED', 'SKIPPED_SHORT_NO_SPEECH') THEN published_at END) AS cursor FROM registry GROUP BY source_key)"


@q("terminal_cursor", f"WITH {REGISTRY}, {CURSOR} SELECT source_key, cursor FROM cursors")
def terminal_cursor(spark, d):
    return state.terminal_cursor(registry(spark, d), ["source_key"])


@q("incremental_new", f"WITH {REGISTRY}, {CURSOR} SELECT content_id FROM registry LEFT JOIN cursors USING (source_key) WHERE cursor IS NULL OR published_at > cursor")
def incremental_new(spark, d):
    return state.after_cursor(registry(spark, d), terminal_cursor(spark, d), ["source_key"]).select("content_id")


@q("state_lookup", f"WITH {REGISTRY} SELECT l_orderkey AS content_id, l_linenumber AS line, status FROM lineitem LEFT JOIN registry ON content_id = l_orderkey")
def state_lookup(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("line"))
    return lines.join(registry(spark, d).select("content_id", "status"), "content_id", "left")


def _updates(spark, d):
    return registry(spark, d).where("content_id % 3 = 0").select("content_id", "source_key", F.lit("COMPLETED").alias("status"), "published_at", F.when(F.col("content_id") % 2 == 0, F.lit("moved")).otherwise(F.col("url")).alias("url"))


@q("upsert_items", f"WITH {REGISTRY} SELECT content_id, CASE WHEN content_id % 3 = 0 THEN 'COMPLETED' ELSE status END AS status, CASE WHEN content_id % 6 = 0 THEN 'moved' ELSE url END AS url FROM registry")
def upsert_items(spark, d):
    return state.upsert(registry(spark, d), _updates(spark, d), ["content_id"]).select("content_id", "status", "url")


@q("identity_conflicts", f"WITH {REGISTRY} SELECT content_id, url AS old_url, 'moved' AS new_url FROM registry WHERE content_id % 6 = 0")
def identity_conflicts(spark, d):
    return state.identity_conflicts(registry(spark, d), _updates(spark, d), ["content_id"], ["url"])


@q("attempt_counter", with_("attempts") + "SELECT task_id, count(*) AS attempts, max_by(flag, (round, provider, item_id)) AS last_flag FROM attempts GROUP BY task_id")
def attempt_counter(spark, d):
    return attempts(spark, d).groupBy("task_id").agg(F.count("*").alias("attempts"), F.max_by("flag", F.struct("round", "provider", "item_id")).alias("last_flag"))


@q("alias_merge", f"WITH {REGISTRY} SELECT CASE source_key WHEN 7 THEN 8 ELSE source_key END AS source_key, count(*) AS n, max(published_at) AS latest FROM registry GROUP BY 1")
def alias_merge(spark, d):
    rows, _ = state.merge_alias(registry(spark, d), "source_key", 7, 8, "content_id")
    return rows.groupBy(F.col("source_key").cast("long").alias("source_key")).agg(F.count("*").alias("n"), F.max("published_at").alias("latest"))


@q("alias_overlap", "SELECT DISTINCT l_partkey AS content_id FROM lineitem WHERE l_suppkey = 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)")
def alias_overlap(spark, d):
    return state.merge_alias(table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("content_id")), "l_suppkey", 1, 2, "content_id")[1]


def _local(spark, d):
    return registry(spark, d).where("source_key % 4 <> 0 and content_id % 11 <> 0").withColumn("status", F.when(F.col("content_id") % 13 == 0, "CHANGED").otherwise(F.col("status")))


@q("consistency_check", f"WITH {REGISTRY} SELECT content_id, CASE WHEN content_id % 17 = 0 THEN 'missing_central' WHEN content_id % 13 = 0 THEN 'mismatch' ELSE 'match' END AS finding FROM registry WHERE source_key % 4 <> 0 AND content_id % 11 <> 0")
def consistency_check(spark, d):
    return state.consistency(_local(spark, d), registry(spark, d).where("content_id % 17 <> 0"), ["content_id"], ["status", "url"])


@q("consistency_reverse", f"WITH {REGISTRY} SELECT content_id FROM registry r WHERE content_id % 11 = 0 AND source_key % 4 <> 0 AND EXISTS (SELECT 1 FROM registry l WHERE l.source_key = r.source_key AND l.content_id % 11 <> 0)")
def consistency_reverse(spark, d):
    return state.missing_local(_local(spark, d), registry(spark, d), ["content_id"], ["source_key"]).select("content_id")


@q("pending_content", f"WITH {REGISTRY} SELECT DISTINCT l_orderkey AS content_id FROM lineitem WHERE l_orderkey NOT IN (SELECT content_id FROM registry WHERE status IN ('COMPLETED', 'SKIPPED_SHORT_NO_SPEECH'))")
def pending_content(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("content_id")).distinct()
    return found.join(terminal_content(spark, d), "content_id", "left_anti")


@q("pending_items", with_("evidence") + f"SELECT evidence_id FROM evidence WHERE {BETWEEN} AND evidence_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(spark, d):
    return window_select(spark, d).select("evidence_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("evidence_id")), "evidence_id", "left_anti")


@q("stale_rejections", "SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stale_rejections(spark, d):
    labels = table(spark, d, "labels")
    return labels.where("toxic = 1").select("doc_id").join(labels.where("quality = 1"), "doc_id", "left_anti")


@q("missing_refs", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def missing_refs(spark, d):
    return table(spark, d, "events").select("event_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("event_id")), "event_id", "left_anti")


@q("latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark, d):
    return state.latest(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@q("runlog_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE json_valid(props)) WHERE n <= 5")
def runlog_tail(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    parsed = table(spark, d, "events").where(F.from_json("props", "k long").isNotNull())
    return parsed.withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@q("runlog_counts", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def runlog_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@q("watermark_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start_at, count(*) AS n FROM events GROUP BY 1, 2")
def watermark_counts(spark, d):
    from ..streaming.runlog import reconciled_counts

    return reconciled_counts(table(spark, d, "events"))


@q("dedup_last_wins", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_last_wins(spark, d):
    return state.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@q("latest_version", "SELECT p_brand AS family, max_by(p_partkey, (p_size, p_partkey)) AS prompt FROM part GROUP BY p_brand")
def latest_version(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("prompt"))


@q("best_variant", "SELECT l_orderkey AS post, arg_max(l_partkey, (l_quantity, -l_linenumber, -l_partkey)) AS variant FROM lineitem GROUP BY l_orderkey")
def best_variant(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("post")).agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("variant"))


@q("first_artifact", "SELECT lang, source, min_by(doc_id, (url, doc_id)) AS first_id FROM (SELECT *, sha256(text) AS url FROM documents WHERE length(text) > 200) GROUP BY lang, source")
def first_artifact(spark, d):
    valid = table(spark, d, "documents").where(F.length("text") > 200).withColumn("url", F.sha2("text", 256))
    return valid.groupBy("lang", "source").agg(F.min_by("doc_id", F.struct("url", "doc_id")).alias("first_id"))


@q("merge_prefer_right", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN c_name END, s_name) AS name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def merge_prefer_right(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("meta"))
    return table(spark, d, "supplier").join(meta, "s_suppkey", "left").select("s_suppkey", F.coalesce("meta", "s_name").alias("name"))


@q("discovery_window", "SELECT o_orderkey AS task_id, o_orderdate AS published_at FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def discovery_window(spark, d):
    return tasks(spark, d).where((F.col("published_at") > F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("published_at") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("task_id", "published_at").orderBy("published_at", "task_id")


@q("discovery_order", "SELECT o_orderkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS oldest FROM orders")
def discovery_order(spark, d):
    w = Window.partitionBy("source_id")
    return tasks(spark, d).select("task_id", F.row_number().over(w.orderBy(F.col("published_at").desc(), F.col("task_id").desc())).cast("long").alias("newest"), F.row_number().over(w.orderBy("published_at", "task_id")).cast("long").alias("oldest"))


@q("batch_ids", "SELECT o_custkey AS source, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS batch, o_orderkey AS id FROM orders")
def batch_ids(spark, d):
    w = Window.partitionBy("source_id").orderBy("task_id")
    return tasks(spark, d).select(F.col("source_id").alias("source"), F.floor((F.row_number().over(w) - 1) / 10).cast("long").alias("batch"), F.col("task_id").alias("id"))


@q("manifest_duplicates", "SELECT n_regionkey AS platform, s_nationkey AS handle, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2 HAVING count(*) > 1")
def manifest_duplicates(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("platform"), F.col("s_nationkey").alias("handle")).agg(F.count("*").alias("n")).where("n > 1")


@q("extension_counts", r"SELECT coalesce(nullif(regexp_extract(url, '\.([a-z]+)(?:[?#]|$)', 1), ''), 'none') AS extension, count(*) AS n FROM pages GROUP BY 1")
def extension_counts(spark, d):
    ext = F.regexp_extract("url", r"\.([a-z]+)(?:[?#]|$)", 1)
    return table(spark, d, "pages").groupBy(F.when(ext == "", "none").otherwise(ext).alias("extension")).agg(F.count("*").alias("n"))


@q("valid_transcript", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '^[0-9:., >-]+$'))) > 0 AS valid FROM documents")
def valid_transcript(spark, d):
    return table(spark, d, "documents").select("doc_id", F.exists(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^[0-9:., >-]+$")).alias("valid"))


@q("published_coalesce", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('day', ts) END AS published_at FROM events")
def published_coalesce(spark, d):
    epoch = F.when(F.col("event_id") % 3 == 0, F.unix_timestamp(F.col("ts").cast("timestamp")))
    day = F.when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyyMMdd"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(day, F.lit("yyyyMMdd"))).cast("timestamp_ntz").alias("published_at"))


@q("explode_join", "SELECT p.l_orderkey AS post, p.l_partkey AS media_key, part.p_name AS name FROM lineitem p LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def explode_join(spark, d):
    """Posts with arrays of media keys against the media table; a missing one stays with a null name."""
    posts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("post")).agg(F.collect_list("l_partkey").alias("keys"))
    media = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("media_key"), F.col("p_name").alias("name"))
    return posts.select("post", F.explode("keys").alias("media_key")).join(media, "media_key", "left").select("post", "media_key", "name")


@q("resume_state", "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'reusable' WHEN 'P' THEN 'resumable' ELSE 'ignore' END AS resume FROM orders")
def resume_state(spark, d):
    """By key and outcome: a complete result is reused, a running one resumed, anything else ignored."""
    return tasks(spark, d).select("task_id", F.when(F.col("outcome") == "F", "reusable").when(F.col("outcome") == "P", "resumable").otherwise("ignore").alias("resume"))
