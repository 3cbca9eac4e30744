"""URL filtering by Bloom filter cascades (operator 10), DataFrame functions only.

A cascade stores a list of keys exactly with respect to a complete key universe. Level 1 is a Bloom filter of the
listed keys; level 2 one of the universe's unlisted keys that level 1 lets through; level 3 one of the listed keys that
level 2 lets through, and so on until a level lets nothing wrong through. Level 1 lets through about as many unlisted keys
as there are listed ones, whatever the universe's size, and each later level about a quarter of what it should stop, so
that all levels together are of the order of the listed keys times the logarithm of the universe per listed key. A key's first rejecting level decides: an odd
one says unlisted, an even one says listed; without any, the last level's side holds. The universe is every candidate
key of the corpus, so the answers are exact for it and no URL row is ever joined or shuffled: each filter is one literal
of the plan. Lists of more than MOST_KEYS keys are dealt by hash into several cascades, each over its part of the
universe; a cascade's filters have about 1.44 * log2(universe / listed) + 6 bits a listed key, and a literal three times
that, so that a million listed keys among 10^10 make a plan of about 10 MB. The only shuffle is the distinct of candidate
keys, combined before it is sent.

Null cases: a null URL, or one without "://", has empty host and path, fits no rule and is allowed. Repeated rows are
judged alike and all kept. An empty table gives an empty result; without rules and listed domains all is allowed. Extra columns are passed over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Names that are blocked, with all their subdomains, where no rule fits, and the domains they stand under. A small list: a
#: longer one is handed to url_verdicts(listed=...), as listed_hosts() or as it is.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")

#: Listed keys of one cascade.
MOST_KEYS = 1_000_000
#: Bits a key of the levels after the first, which let a quarter through.
LATER_BITS = 2 / math.log(2)


def listed_hosts(names=LISTED_NAMES, domains=DOMAINS) -> tuple[str, ...]:
    """Each name under each domain."""
    return tuple(f"{name}.{domain}" for name in names for domain in domains)


LISTED_DOMAINS = listed_hosts()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Bloom:
    words: tuple[int, ...]  # 64 bits each
    hashes: int

    def passes(self, key: Column, level: int) -> Column:
        # one literal, which Spark folds into an array of longs
        words, bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>"), 64 * len(self.words)
        test = F.lit(True)
        for i in range(self.hashes):
            p = _position(key, level, i, bits)
            test = test & (F.call_function("shiftrightunsigned", F.element_at(words, (p / 64).cast("int") + 1), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1000 * level + i), key), F.lit(bits)).cast("long")


def _bloom(keys: DataFrame, count: int, level: int, bits_per_key: float) -> Bloom:
    """Set bits are gathered by word; at most the filter's own size reaches the driver."""
    words = max(1, math.ceil(count * bits_per_key / 64))
    hashes = max(1, round(bits_per_key * math.log(2)))
    bits = 64 * words
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(hashes)])).alias("p"))
    set_words = at.selectExpr("cast(p div 64 as int) as w", "shiftleft(1L, cast(p % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    found = {r["w"]: r["b"] for r in set_words.collect()}
    return Bloom(tuple(found.get(i, 0) for i in range(words)), hashes)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _levels(listed: DataFrame, universe: DataFrame, most: int) -> tuple[Bloom, ...]:
    levels: list[Bloom] = []
    wrong = [listed, universe]
    count = wrong[0].count()
    # level 1 lets through as many unlisted keys as there are listed ones
    bits = max(LATER_BITS, math.log2(max(1, wrong[1].count()) / max(1, count)) / math.log(2))
    while count and len(levels) < most:
        side = len(levels) % 2
        bloom = _bloom(wrong[side], count, len(levels), LATER_BITS if levels else bits)
        levels.append(bloom)
        wrong[1 - side] = wrong[1 - side].where(bloom.passes(F.col("key"), len(levels) - 1))
        count = wrong[1 - side].count()
    if count:
        raise RuntimeError("the cascade did not close; its hash functions are broken")
    return tuple(levels)


@dataclass(frozen=True)
class Cascade:
    """Filters, level by level, of each part of the keys."""

    parts: tuple[tuple[Bloom, ...], ...]

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> "Cascade":
        """listed and universe: one column key, distinct. Listed keys need not occur in the universe."""
        unlisted = universe.select("key").join(listed.select("key"), "key", "left_anti")
        parts = max(1, math.ceil(listed.count() / MOST_KEYS))
        if parts == 1:
            return Cascade((_levels(listed.select("key"), unlisted, max_levels),))
        return Cascade(tuple(_levels(*(side.select("key").where(_part(F.col("key"), parts) == i) for side in (listed, unlisted)), max_levels) for i in range(parts)))

    def holds(self, key: Column) -> Column:
        held = F.lit(False)
        for part, levels in enumerate(self.parts):
            # without a rejecting level, the last level's side: listed for an odd number of levels
            verdict = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                verdict = F.when(~levels[i].passes(key, i), F.lit(i % 2 == 1)).otherwise(verdict)
            held = verdict if len(self.parts) == 1 else F.when(_part(key, len(self.parts)) == part, verdict).otherwise(held)
        return held


def candidates(host: Column, path: Column, keys: list[tuple[str, str]]) -> Column:
    """Every key that a rule of this shape could have for the URL: host suffixes of at most as many labels as any rule
    has, with path prefixes of the rules' lengths."""
    deepest = max((len(h.split(".")) for h, _ in keys), default=0)
    lengths = sorted({len(p) for _, p in keys})
    labels = F.split(host, r"\.")
    parts = []
    for n in range(1, deepest + 1):
        suffix = F.array_join(F.slice(labels, F.lit(-n), F.lit(n)), ".")
        for length in lengths:
            fits = (F.size(labels) >= n) & (F.length(path) >= length) & (host != "")
            parts.append(F.when(fits, F.concat(suffix, F.substring(path, 1, length))))
    return F.filter(F.array(*parts).cast("array<string>"), lambda k: k.isNotNull())


def url_verdicts(pages: DataFrame, rules=RULES, listed=LISTED_DOMAINS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    spark = pages.sparkSession
    shapes = [(h, p) for _, h, p in rules] + [(d, "") for d in listed]
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    universe = materialise(urls.select(F.explode("keys").alias("key")).distinct(), "url-keys")

    def cascade(keys):
        return Cascade.build(spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string"), universe)

    # a rule's key has a path and so a slash, a listed domain's has none
    blocks = cascade([h + p for v, h, p in rules if v == "block"] + list(listed))
    allows = cascade(h + p for v, h, p in rules if v == "allow")
    tagged = F.filter(F.transform("keys", lambda k: F.when(blocks.holds(k), F.concat(F.lit("b"), k)).when(allows.holds(k), F.concat(F.lit("a"), k))), lambda k: k.isNotNull())
    found = urls.select("page_id", "host", "path", tagged.alias("found"))
    longest = F.reduce(
        F.filter("found", lambda k: k.contains("/")),
        F.lit(None).cast("string"),
        lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a),
    )
    ruled = found.withColumn("best", longest)
    blocked = F.when(F.col("best").isNotNull(), F.col("best").startswith("b")).otherwise(F.size("found") > 0)
    return ruled.select("page_id", "host", "path", F.expr("substring(best, 2)").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def query(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def oracle(listed) -> str:
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} ELSE NULL END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in RULES)}
  WHEN {" OR ".join(_fits(d, "") for d in listed)} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


ORACLE = oracle(LISTED_DOMAINS)
