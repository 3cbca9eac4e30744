"""Queries of source addresses, manifests, projections and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators.controllers import rejection
from ..sources import manifest
from .entities import Registry, attempts, evidence, table, with_

q = Registry()
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
BARE = f"regexp_replace({PATH}, '/+$', '')"


@q("videos_tab", f"SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN ends_with({BARE}, '/videos') THEN {BARE} ELSE {BARE} || '/videos' END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS tab FROM pages")
def videos_tab(spark, d):
    return table(spark, d, "pages").select("page_id", ids.videos_tab(F.col("url")).alias("tab"))


#: Channel addresses of every kind, by type of event.
CHANNEL = "CASE event_type WHEN 'view' THEN 'https://www.youtube.com/@u' || user_id WHEN 'click' THEN 'https://www.youtube.com/channel/UC' || user_id || '/videos' WHEN 'signup' THEN 'https://www.youtube.com/user/u' || user_id || '/' WHEN 'error' THEN 'https://www.youtube.com/c/u' || user_id ELSE 'UC' || user_id END"


@q("channel_selector", "SELECT event_id, CASE event_type WHEN 'view' THEN 'forHandle' WHEN 'signup' THEN 'forUsername' WHEN 'error' THEN NULL ELSE 'id' END AS parameter, CASE event_type WHEN 'view' THEN '@u' || user_id WHEN 'signup' THEN 'u' || user_id WHEN 'error' THEN NULL ELSE 'UC' || user_id END AS value FROM events")
def channel_selector(spark, d):
    return table(spark, d, "events").select("event_id", ids.channel_selector(F.expr(CHANNEL)).alias("s")).select("event_id", "s.parameter", "s.value")


@q("entry_url", "SELECT event_id, CASE WHEN starts_with(url, 'https') THEN url WHEN starts_with(event_type, 'http') THEN event_type ELSE 'https://www.youtube.com/watch?v=' || event_id END AS address FROM events LEFT JOIN pages ON page_id = event_id")
def entry_url(spark, d):
    both = table(spark, d, "events").select("event_id", "event_type").join(table(spark, d, "pages").select(F.col("page_id").alias("event_id"), "url"), "event_id", "left")
    secure = F.when(F.col("url").startswith("https"), F.col("url"))
    return both.select("event_id", ids.entry_url(secure, F.col("event_type"), F.col("event_id").cast("string")).alias("address"))


SUFFIX = f"lower(regexp_extract({PATH}, '[^/.][^/]*?(\\.[^./]+)$', 1))"


@q("media_extension", "SELECT page_id, CASE WHEN " + SUFFIX + " IN (" + ", ".join(f"'{e}'" for e in ids.MEDIA_EXTENSIONS) + ") THEN " + SUFFIX + " WHEN starts_with(url, 'https') THEN '.png' ELSE '.bin' END AS extension FROM pages")
def media_extension(spark, d):
    kind = F.when(F.col("url").startswith("https"), "image/png; q=1").otherwise("no/such")
    return table(spark, d, "pages").select("page_id", ids.media_extension(F.col("url"), kind).alias("extension"))


@q("producer", "SELECT doc_id, CASE lang WHEN 'en' THEN 'YOUTUBE CHANNEL: ' || source WHEN 'de' THEN 'X ACCOUNT: @' || source ELSE 'SOURCE ACCOUNT: ' || source END AS producer FROM documents")
def producer(spark, d):
    platform = F.when(F.col("lang") == "en", "YouTube").when(F.col("lang") == "de", "x").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", ids.producer(platform, F.col("source")).alias("producer"))


def _manifest(spark, d):
    """Suppliers as configured sources, their region as platform."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("platform"))
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(places, "s_nationkey").select(F.col("s_suppkey").alias("handle"), "platform")


MANIFEST = "m AS (SELECT s_suppkey AS handle, r_name AS platform FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@q("manifest_platform", f"WITH {MANIFEST} SELECT handle FROM m WHERE lower(platform) = 'asia'")
def manifest_platform(spark, d):
    return manifest.of_platform(_manifest(spark, d), "Asia").select("handle")


@q("unsupported_platforms", f"WITH {MANIFEST} SELECT handle, platform FROM m WHERE lower(platform) NOT IN ('asia', 'europe')")
def unsupported_platforms(spark, d):
    return manifest.unsupported(_manifest(spark, d), ["asia", "europe"])


@q("label_view", "SELECT event_id, event_type AS label FROM events WHERE event_type IN ('error', 'signup')")
def label_view(spark, d):
    """A report's rows of the labels asked for; of all, where none is named."""
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("label")).where(F.col("label").isin("error", "signup"))


@q("evidence_projection", with_("evidence") + "SELECT evidence_id, platform, source_key, 'https://example.org/' || evidence_id AS canonical_url, published_at, text AS snippet FROM evidence")
def evidence_projection(spark, d):
    """The fixed columns that a case carries of its evidence."""
    address = F.concat(F.lit("https://example.org/"), F.col("evidence_id").cast("string"))
    return evidence(spark, d).select("evidence_id", "platform", "source_key", address.alias("canonical_url"), "published_at", F.col("text").alias("snippet"))


@q("results_order", with_("attempts") + "SELECT task_id, round, status FROM attempts ORDER BY task_id, round")
def results_order(spark, d):
    return attempts(spark, d).select("task_id", "round", "status").orderBy("task_id", "round")


@q("short_repair", "SELECT l_orderkey AS content_id, l_linenumber AS line, o_orderstatus AS registered FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'F' WHERE l_quantity < 5")
def short_repair(spark, d):
    """Short items of the state with what the registry says of them, null where it says nothing."""
    short = table(spark, d, "lineitem").where("l_quantity < 5").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("line"))
    known = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("content_id"), F.col("o_orderstatus").alias("registered"))
    return short.join(known, "content_id", "left")


@q("backfill_missing", "SELECT event_id, CASE WHEN page_id IS NULL THEN 'NOT_RETURNED:' || event_id END AS warning, url FROM events LEFT JOIN pages ON page_id = event_id")
def backfill_missing(spark, d):
    """Posts asked for by id against those that came back; a missing one is a warning."""
    got = table(spark, d, "pages").select(F.col("page_id").alias("event_id"), "url", F.lit(True).alias("there"))
    warning = F.when(F.col("there").isNull(), F.concat(F.lit("NOT_RETURNED:"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id").join(got, "event_id", "left").select("event_id", warning.alias("warning"), "url")


@q("rejections", "SELECT event_id, CAST(user_id AS VARCHAR) AS item_id, CASE event_type WHEN 'error' THEN 'TimeoutError' ELSE 'ValidationError' END AS error_type, CASE event_type WHEN 'error' THEN 'PROVIDER: TimeoutError: late' ELSE event_type END AS error, value AS attempts FROM events")
def rejections(spark, d):
    error = F.when(F.col("event_type") == "error", "PROVIDER: TimeoutError: late").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", rejection(F.col("user_id").cast("string"), error, F.col("value")).alias("r")).select("event_id", "r.*")
