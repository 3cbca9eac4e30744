"""Chat formatting (operator 9): cumulative-snapshot collapse, then rendering. DataFrame functions only.

Logs hold snapshots of growing conversations. Each turn gets two 64-bit hashes of its position, role and text; the xor of
a conversation's first k turns is the hash of that prefix, a running aggregate over hashes alone. A conversation whose
whole hash is also the hash of a proper prefix of another one is a snapshot of it: an anti-join on (length, hash) leaves
the maximal ones, of which equal ones are one, under the smallest conv_id. Both sides of that join are aggregated before
they are sent, so that a common first turn or a conversation logged a million times is one row. Only the turns of maximal
conversations are gathered and rendered, in parts of at most PART turns.

No step needs a whole conversation in one task: positions and running hashes are taken within blocks of 2**STEP, and what
lies before a block comes from the blocks' own counts and hashes, again in blocks. One conversation may hold any share of
all rows.

Defined cases: turns are ordered by turn, role and the text's MD5, nulls first; turns that repeat are all kept. A null
role is rendered as "unknown", a null text as an empty one; both differ from the written-out values in the comparison.
Where a role or text holds a marker's beginning, "<|im_", it is written "< |im_", so that no text can pass for a turn. Rows with
a null conv_id make one conversation. An empty table gives no rows. Extra columns are passed over. A conversation of more
than PART turns has a row for each part, from 0; the parts' chats in a row are its chat.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

OPEN, SHUT, MARKER = "<|im_start|>", "<|im_end|>\n", "<|im_"
PART = 512  # turns a rendered row
STEP, LEVELS = 10, 2  # bits a block, blocks of blocks


def _hash(seed: int, *values: Column) -> Column:
    parts = [p for v in values for p in (v.isNull(), v)]
    return F.xxhash64(F.lit(seed), *parts)


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(MARKER), F.lit(f"{MARKER[0]} {MARKER[1:]}"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right where all keys are equal, null with null; the keys come once."""
    there = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(there, on, how).drop(*[f"_{k}" for k in keys])


def _before(blocks: DataFrame, values: list[str], fold: Callable, add: Callable, levels: int = LEVELS) -> DataFrame:
    """conv_id, b and, for each value, what it folds to over the conversation's earlier blocks. Windows hold 2**STEP blocks
    at most, but for those over the last level."""
    split = blocks.withColumn("c", F.shiftright("b", STEP) if levels else F.lit(0).cast("long"))
    earlier = Window.partitionBy("conv_id", "c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    here = split.select("conv_id", "b", "c", *[F.coalesce(fold(v).over(earlier), F.lit(0)).alias(v) for v in values])
    if not levels:
        return here.drop("c")
    above = split.groupBy("conv_id", F.col("c").alias("b")).agg(*[fold(v).alias(v) for v in values])
    outer = _before(above, values, fold, add, levels - 1).select("conv_id", F.col("b").alias("c"), *[F.col(v).alias(f"{v}_c") for v in values])
    return _joined(here, outer, ["conv_id", "c"]).select("conv_id", "b", *[add(F.col(v), F.col(f"{v}_c")).alias(v) for v in values])


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place from 1), role, text, body (the text's MD5) of every turn."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("body", F.md5(F.col("text").cast("binary")))
    turns = turns.withColumn("sub", F.substring("body", 1, 2))
    cell = ["conv_id", "turn", "role", "sub"]
    cells = turns.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("b", F.shiftright("turn", STEP))
    blocks = cells.groupBy("conv_id", "b").agg(F.sum("n").alias("n"))
    skipped = _before(blocks, ["n"], F.sum, Column.__add__).withColumnRenamed("n", "skipped")
    earlier = Window.partitionBy("conv_id", "b").orderBy("turn", "role", "sub").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    first = _joined(inside, skipped, ["conv_id", "b"]).select(*cell, (F.col("inside") + F.col("skipped")).alias("first"))
    k = F.col("first") + F.row_number().over(Window.partitionBy(*cell).orderBy("body"))
    return _joined(turns, first, cell).select("conv_id", k.alias("k"), "role", "text", "body")


def _prefixes(numbered: DataFrame) -> DataFrame:
    """conv_id, k, p, q (hash of the first k turns), last (k is the whole length)."""
    hashes = numbered.select("conv_id", "k", F.shiftright(F.col("k") - 1, STEP).alias("b"), *[_hash(seed, F.col("k"), F.col("role"), F.col("body")).alias(c) for seed, c in ((1, "p"), (2, "q"))])
    blocks = hashes.groupBy("conv_id", "b").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    skipped = _before(blocks, ["p", "q"], F.bit_xor, Column.bitwiseXOR).withColumnsRenamed({"p": "p_b", "q": "q_b"})
    running = Window.partitionBy("conv_id", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashes.select("conv_id", "b", "k", F.bit_xor("p").over(running).alias("p"), F.bit_xor("q").over(running).alias("q"))
    whole = _joined(inside, skipped, ["conv_id", "b"]).select("conv_id", "k", F.col("p").bitwiseXOR(F.col("p_b")).alias("p"), F.col("q").bitwiseXOR(F.col("q_b")).alias("q"))
    lengths = numbered.groupBy("conv_id").agg(F.max("k").alias("k")).withColumn("last", F.lit(True))
    return _joined(whole, lengths, ["conv_id", "k"], "left").withColumn("last", F.coalesce("last", F.lit(False)))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, part, chat of each maximal conversation of (conv_id, turn, role, text)."""
    numbered = materialise(_numbered(conversations), "chat-turns")
    prefixes = materialise(_prefixes(numbered), "chat-prefixes")
    shorter = prefixes.where("not last").select("k", "p", "q").distinct()
    complete = prefixes.where("last").groupBy("k", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    maximal = complete.join(shorter, ["k", "p", "q"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")
    part = F.expr(f"(k - 1) div {PART}").alias("part")
    # One small row a part meets its conversation, so that texts are sent by part.
    parts = _joined(prefixes.where(f"(k - 1) % {PART} = 0").select("conv_id", part), maximal, ["conv_id"])
    texts = _joined(numbered.select("conv_id", "k", "role", "text", part), parts, ["conv_id", "part"])
    turn = F.struct("k", _plain(F.coalesce("role", F.lit("unknown"))).alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
    gathered = texts.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(SHUT)))
    return gathered.select("conv_id", "n_turns", "n_copies", "part", F.array_join(rendered, "").alias("chat"))


def query(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '< |im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS piece
  FROM conversations
), p AS (
  SELECT conv_id, k, n, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chat FROM t
), c AS (SELECT chat, min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_copies FROM p WHERE k = n GROUP BY chat, k
), m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = c.n_turns AND p.chat = c.chat))
SELECT m.conv_id, m.n_turns, m.n_copies, (t.k - 1) // {PART} AS part, string_agg(t.piece, '' ORDER BY t.k) AS chat
FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""
