"""Line dedup (operator 2) by a log-template tree. DataFrame functions only.

Each line is parsed along a tree of fixed depth: by its number of tokens, then by its first LEADING tokens. Tokens with a
digit are variable fields, "<*>". In a leaf, lines belong to one template if they agree but for one quarter of their
other tokens: each line has one key for its whole template and, from GENERALISED tokens on, one for each quarter left
open. Runs of white space, Unicode's as well, are one blank, and a token ends there; a line without any is one token. All
of this is string functions in generated code, on each text once. A template recurs if it
stands in CONTEXTS or more different documents, where documents with the same set of lines are copies and count as one:
boilerplate stands in ever other documents, while the lines of copies alone are left to document dedup. Lines of a
recurring template are dropped from all documents but the one with the smallest doc_id, so that each text stays in the
corpus once. Lines of fewer than LEADING tokens have all their tokens as leading ones, and so one key for the whole; empty
lines are no templates and stay.

Texts are never exploded for good: hashes and line numbers are shuffled, and each document is rebuilt in one join with
the numbers of its dropped lines. Counts are combined before they are sent; hot templates are a skew join of small rows.

Defined cases: a null text stays null, with no lines; an empty one is one empty line and stays. Documents all of whose
lines are dropped have an empty text. Rows that repeat doc_id and text are treated alike and all kept. A null doc_id comes
before all others. Empty tables give no rows. Columns other than doc_id and text are handed through by dedup_lines().
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

LEADING, GENERALISED, CONTEXTS, QUARTERS = 3, 8, 2, 4
#: A token with a digit. It is tried at token starts only and never gives back, so that long tokens cost one pass.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"

#: White space but for line breaks: of one byte in Latin 1 and the rest; and runs of it that are not one blank.
NARROW, WIDE = "\t\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0", "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
UNEVEN = f"[{NARROW}{WIDE}][ {NARROW}{WIDE}]*+| [ {NARROW}{WIDE}]++"


def _even(text: Column) -> Column:
    """text with runs of white space as one blank. The tests before the search are of bytes, as few texts need it."""
    wide = (F.octet_length(text) != F.length(text)) & reduce(or_, [F.contains(text, F.lit(c)) for c in WIDE])
    uneven = F.contains(text, F.lit("  ")) | text.rlike(f"[{NARROW}]") | wide
    return F.when(uneven, F.regexp_replace(text, UNEVEN, " ")).otherwise(text)


def _keys(line: Column, n: Column) -> Column:
    """The whole template, and those with one quarter of what follows the leading tokens left open."""
    keys = [F.xxhash64(F.lit(0), line)]
    ends = [F.lit(LEADING) + F.floor((n - LEADING) * b / QUARTERS).cast("int") for b in range(QUARTERS + 1)]
    parts = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
    opened = [F.xxhash64(F.lit(b + 1), n, parts(ends[b]), parts(ends[b + 1] - n)) for b in range(QUARTERS)]
    return F.when(n >= GENERALISED, F.array(*keys, *opened)).otherwise(F.array(*keys))


def dropped_lines(documents: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, version (a hash of the text), and the numbers of the lines to drop; documents without any are missing."""
    docs = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), _even(F.col("text")).alias("even"))
    masked = F.when(F.col("even").rlike("[0-9]"), F.regexp_replace("even", VARIABLE, "<*>")).otherwise(F.col("even"))
    lines = F.transform(F.split(masked, "\n", -1), lambda x: F.btrim(x, F.lit(" ")))
    docs = docs.select("doc_id", "version", lines.alias("lines"))
    # the lines as a set: copies have the same, in whatever order
    whole = F.xxhash64(F.sort_array(F.array_distinct(F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.xxhash64(x)))))
    # outer, as Spark would else parse each text again to test for lines; there is always one
    each = docs.select("doc_id", "version", whole.alias("context"), F.posexplode_outer("lines").alias("at", "line")).where("line <> ''")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    each = each.select("doc_id", "version", "at", "line", "context", n.alias("n"))
    keyed = materialise(each.select("doc_id", "version", "at", "context", F.explode(_keys(F.col("line"), F.col("n"))).alias("key")), "line-keys")
    among = keyed.groupBy("key", "context").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"))
    recurring = among.groupBy("key").agg(F.count("*").alias("contexts"), F.min("first").alias("first")).where(F.col("contexts") >= contexts)
    hit = keyed.select("doc_id", "version", "at", "key").join(recurring.select("key", "first"), "key").where(F.coalesce("doc_id", F.lit(-(2**63))) != F.col("first"))
    return hit.groupBy("doc_id", "version").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(documents: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """documents with the text of the lines that stay, n_lines (all lines) and n_dropped; other columns as they are
    (columns of the counts' names are replaced)."""
    drops = dropped_lines(documents, contexts).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("dropped").alias("_dropped"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_version"))
    joined = documents.join(drops, same, "left")
    lines, dropped = F.split("text", "\n", -1), F.col("_dropped")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    text = F.when(dropped.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    counts = {
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.when(dropped.isNotNull(), F.size(dropped)), F.lit(0)).cast("long"),
    }
    kept = [text.alias(c) if c == "text" else F.col(c) for c in documents.columns if c not in counts]
    return joined.select(*kept, *[v.alias(k) for k, v in counts.items()])


def query(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
