"""Stable ids, hashes and URLs."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def evidence_id(platform: Column, source_key: Column, content_id: Column, kind: Column, path: Column) -> Column:
    """Null if any part is: concat, unlike concat_ws, doesn't skip nulls."""
    sep = F.lit(SEPARATOR)
    return F.sha2(F.concat(platform, sep, source_key, sep, content_id, sep, kind, sep, path), 256)


def chunk_id(evidence: Column, index: Column, locator: Column, text: Column) -> Column:
    """A missing locator is written as None."""
    sep = F.lit(SEPARATOR)
    return F.sha2(F.concat(evidence, sep, index.cast("string"), sep, F.coalesce(locator, F.lit("None")), sep, text), 256)


def task_id(question: Column) -> Column:
    return F.concat(F.lit("research-"), F.substring(F.sha2(question, 256), 1, 16))


def canonical_url(platform: Column, url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or last slash; a channel's /videos is the channel."""
    u = F.trim(url)
    scheme, host = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/+$", "")
    channel = F.when((F.lower(platform) == "youtube") & path.endswith("/videos"), F.regexp_replace(path, "/videos$", "")).otherwise(path)
    return F.when((scheme == "") | (host == ""), F.regexp_replace(u, "/+$", "")).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), channel))


def content_folder(published: Column, content_id: Column) -> Column:
    """YYYYMMDD_id; null for an id that would leave its folder."""
    safe = (content_id != "") & ~content_id.rlike(r"[/\\]") & ~content_id.isin(".", "..")
    return F.when(safe, F.concat(F.date_format(published, "yyyyMMdd"), F.lit("_"), content_id))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def videos_tab(url: Column) -> Column:
    """A channel's list of uploads: its path ending in /videos, its query kept, its fragment dropped."""
    site, query = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = F.regexp_replace(_path(url), "/+$", "")
    return F.concat(site, F.when(path.endswith("/videos"), path).otherwise(F.concat(path, F.lit("/videos"))), query)


def channel_selector(url: Column) -> Column:
    """struct(parameter, value) that asks for a channel; null where the URL names none. A bare id starts with UC."""
    parts = F.split(F.regexp_replace(_path(url), "^/+|/+$", ""), "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    named = lambda parameter, value: F.struct(F.lit(parameter).alias("parameter"), value.alias("value"))
    return (
        F.when(first.startswith("@"), named("forHandle", first))
        .when((first == "channel") & second.isNotNull(), named("id", second))
        .when((first == "user") & second.isNotNull(), named("forUsername", second))
        .when(url.startswith("UC"), named("id", url))
    )


def entry_url(webpage: Column, original: Column, video_id: Column) -> Column:
    """The first of two fields that is a web address, else the address that the id makes."""
    web = lambda c: F.when(c.startswith("http"), c)
    return F.coalesce(web(webpage), web(original), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id))


# Extensions that a URL may give a downloaded file.
MEDIA_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".mp4", ".m4v", ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")


def media_extension(url: Column, content_type: Column) -> Column:
    """The URL's extension if it is one of MEDIA_EXTENSIONS, else the content type's, else .bin."""
    known = mimetypes.MimeTypes(filenames=())
    guesses = {t: known.guess_extension(t) for t in sorted(set(known.types_map[True].values()))}
    table = F.create_map(*[F.lit(x) for pair in guesses.items() for x in pair])
    suffix = F.lower(F.regexp_extract(_path(url), r"[^/.][^/]*?(\.[^./]+)$", 1))
    plain = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(suffix.isin(*MEDIA_EXTENSIONS), suffix).otherwise(F.coalesce(F.element_at(table, plain), F.lit(".bin")))


def producer(platform: Column, source_key: Column) -> Column:
    """Who made a piece of evidence, as a reader is told."""
    key = F.coalesce(source_key, F.lit(""))
    handle = F.when((key == "") | key.startswith("@"), key).otherwise(F.concat(F.lit("@"), key))
    where = F.lower(F.coalesce(platform, F.lit("")))
    return F.when(where == "youtube", F.concat(F.lit("YOUTUBE CHANNEL: "), key)).when(where == "x", F.concat(F.lit("X ACCOUNT: "), handle)).otherwise(F.concat(F.lit("SOURCE ACCOUNT: "), key))
