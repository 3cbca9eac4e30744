"""Conversation structure repair (operator 13): a backward cost-to-go over turns and grammar states, then a greedy walk.

A conversation's roles, by their initials, are to be (s?(ua)+)?. Four states say what stands before a turn: nothing, a
system turn, a user turn, an assistant turn. Edits are Keep (0), Rerole to what the grammar asks for (1), Delete (2, the
only one for blank turns and repeats) and Insert of an empty turn (5); a truncated turn that stays adds 5. Costs to go run
backward over the turns; the walk runs forward and takes, of the edits on a cheapest way, the one with the least initial.
From one state each edit leads to one state, so the least initial at each step makes the least audit.

No task holds a conversation:

1. Equal turns become one row with a count. They are sorted over range partitions, so that a long conversation lies in many,
   and cut into blocks of BLOCK rows. A block's costs between its states before and after are a 4 x 4 matrix.
2. Costs to go at the ends of blocks are folded from the matrices alone, a row a block, last block first.
3. Turns of a conversation pass through one task, in order, as its hash has to be taken in order: a block at a time, backward
   inside the block from the costs at its end, then forward. Beside the block the task keeps a state, counts, the hash and
   the audit.

Defined cases: null roles and texts are one space, and so are null conv_ids and turns in the damage's key; rows with a null
conv_id are one conversation, returned with a null id. Turns are taken by turn (nulls first), role and the text's MD5; of
equal ones the first is no duplicate. An empty role has no initial and fits nowhere. A conversation of which nothing is left
has zeros, an empty audit and the hash of an empty string. Very long texts make shorter blocks. Empty tables give no rows.
Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, partitions, returning, table

RULE = 20  # a crc32's remainder says what happens to a row
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
#: States: nothing, system, user, assistant. What the grammar asks for in each (beside a system turn first), and where that leads.
ASKED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: Costs after the last turn: inserts until the roles may end.
END = (0, 2 * COST[INSERT], COST[INSERT], 0)
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Rows and characters of a block.
BLOCK, CHARACTERS = 1024, 1 << 22

ROW = ("conv_id", "turn", "role", "text", "copies", "blank", "duplicate", "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage, equal ones once. A conversation that lost rows has a row
    without copies, so that no conversation is lost."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), (F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % RULE).alias("rule"))
    rule = F.col("rule")
    text = F.when(rule < 2, "").when(rule == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(rule == 0, "").when(rule == 4, "user").otherwise(F.col("role"))
    copies = F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1)
    kept = rows.select("conv_id", F.when(rule > 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """The columns ROW and body (the text's MD5): each row's first fault, of rows without equal ones."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumns({"blank": end == "", "truncated": ~F.substring(end, -1, 1).isin(".", "!", "?"), "body": F.md5(F.col("text").cast("binary")), "at": F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))})
    seen = rows.where("copies > 0 and not blank").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("body").alias("_body"))
    again = seen.agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("body") == F.col("_body"))
    met = rows.join(again, same, "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    return met.withColumn("truncated", F.expr("truncated and not blank and not duplicate")).select(*ROW, "body")


def before(turn: tuple[str, bool, int, int], after: tuple[int, ...] | list[int]) -> list[int]:
    """Costs to go before a turn (role initial, whether it must go, what it costs to stay, copies) from those after it."""
    initial, must_go, stays, copies = turn
    costs = [COST[DELETE] + after[s] for s in range(4)]
    if not must_go:
        for s in range(4):
            costs[s] = min(costs[s], COST[REROLE] + stays + after[AFTER[s]])
            if initial == ASKED[s][0]:
                costs[s] = min(costs[s], stays + after[AFTER[s]])
        if initial == "s":
            costs[0] = min(costs[0], stays + after[1])
    for _ in range(3):
        costs = [min(costs[s], COST[INSERT] + costs[AFTER[s]]) for s in range(4)]
    return [c + COST[DELETE] * (copies - 1) for c in costs]


def walk(turns: list[tuple[str, bool, int, int]], state: int, end: tuple[int, ...] | list[int], last: bool) -> tuple[list[tuple[int, str, str | None]], int]:
    """The edits of a block entered in a state, and the state after it: turn, initial and the role that an insert or a
    rerole gives. A turn's copies are left out; inserts come before their turn."""
    to_go = [list(end)]
    for turn in reversed(turns):
        to_go.append(before(turn, to_go[-1]))
    to_go.reverse()
    edits = []
    for k, (initial, must_go, stays, copies) in enumerate(turns):
        here, after = [c - COST[DELETE] * (copies - 1) for c in to_go[k]], to_go[k + 1]
        while True:
            asked = AFTER[state]
            if here[state] == COST[DELETE] + after[state]:
                edits.append((k, DELETE, None))
                break
            if here[state] == COST[INSERT] + here[asked]:
                edits.append((k, INSERT, ASKED[state]))
                state = asked
                continue
            to = 1 if initial == "s" else asked
            fits = initial == ASKED[state][0] or (initial == "s" and state == 0)
            if fits and here[state] == stays + after[to]:
                edits.append((k, KEEP, None))
                state = to
            else:
                edits.append((k, REROLE, ASKED[state]))
                state = asked
            break
    while last and END[state]:
        edits.append((len(turns), INSERT, ASKED[state]))
        state = AFTER[state]
    return edits, state


def _turn(row: dict) -> tuple[str, bool, int, int]:
    return row["role"][:1], row["blank"] or row["duplicate"], TRUNCATED if row["truncated"] else 0, row["copies"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            yield from batch.slice(first, BLOCK).to_pylist()


def _costs(rows: list[dict]) -> list[int]:
    """16 numbers: for each state after the rows, what it costs to get there from each state before them."""
    found = []
    for target in range(4):
        after = [0 if s == target else NEVER for s in range(4)]
        for row in reversed(rows):
            after = [min(c, NEVER) for c in before(_turn(row), after)]
        found += after
    return found


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their block and place; after each block a row of place -1 with its costs."""
    kept: list[dict] = []
    held, number = 0, 0
    schema = None

    def close(rows: list[dict], block: int) -> pa.RecordBatch:
        numbered = [{**row, "block": block, "place": i, "costs": None} for i, row in enumerate(rows)]
        summary = {**rows[0], "turn": None, "role": "", "text": "", "block": block, "place": -1, "costs": _costs([r for r in rows if r["copies"]])}
        return pa.RecordBatch.from_pylist([*numbered, summary], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([*batch.schema, ("block", pa.int64()), ("place", pa.int32()), ("costs", pa.list_(pa.int64()))])
        for row in _rows([batch]):
            if kept and (row["conv_id"] != kept[0]["conv_id"] or len(kept) >= BLOCK or held >= CHARACTERS):
                yield close(kept, number)
                kept, held, number = [], 0, number + 1
            kept.append(row)
            held += len(row["text"])
    if kept:
        yield close(kept, number)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, block, ends (costs to go) of the blocks that aren't their conversation's last, of blocks from last to first."""
    current, to_go = None, END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if current is None or current[0] != row["conv_id"]:
                current, to_go = (row["conv_id"],), END
            else:
                out.append({"pid": row["pid"], "block": row["block"], "ends": list(to_go)})
            costs = row["costs"]
            to_go = [min(costs[4 * target + s] + to_go[target] for target in range(4)) for s in range(4)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("pid", pa.int32()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))]))


class Conversation:
    """What is known of a conversation between two of its blocks."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.edits = conv_id, 0, 0, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.least, self.greatest, self.initial = 0, None, None, None

    def count(self, row: dict) -> None:
        copies, initial, turn = row["copies"], row["role"][:1], row["turn"]
        self.counts["blank"] += copies if row["blank"] else 0
        self.counts["duplicate"] += 0 if row["blank"] else copies if row["duplicate"] else copies - 1
        self.counts["truncated"] += row["truncated"]
        self.counts["illegal"] += copies - 1 + (self.initial is not None and self.initial + initial not in LEGAL)
        self.initial = initial
        if turn is not None and turn != self.greatest:
            self.turns, self.greatest = self.turns + 1, turn
            self.least = turn if self.least is None else self.least

    def block(self, rows: list[dict], last: bool) -> Iterator[dict]:
        """The block's edits in order; role and text are null where a turn is deleted."""
        ends = rows[0]["ends"]
        rows = [row for row in rows if row["copies"]]
        for row in rows:
            self.count(row)
        edits, self.state = walk([_turn(row) for row in rows], self.state, END if last else ends, last)
        for k, edit, role in edits:
            if edit == INSERT:
                yield self._edit(edit, role, "")
                continue
            row = rows[k]
            if edit == DELETE:
                yield self._edit(edit, None, None)
            else:
                self.cost += TRUNCATED if row["truncated"] else 0
                yield self._edit(edit, role or row["role"], row["text"])
            for _ in range(row["copies"] - 1):
                yield self._edit(DELETE, None, None)

    def _edit(self, edit: str, role: str | None, text: str | None) -> dict:
        self.cost += COST[edit]
        self.edits += 1
        return {"conv_id": self.conv_id, "place": self.edits, "edit": edit, "role": role, "text": text}

    def result(self, audit: list[str], digest: str) -> dict:
        gaps = self.greatest - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(audit), "repaired_sha256": digest}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[dict], bool]]:
    """Each block's conversation, its edits and whether it is the last, of rows in order."""
    conversation, kept = None, []
    for row in _rows(batches):
        if kept and (kept[0]["conv_id"], kept[0]["pid"], kept[0]["block"]) != (row["conv_id"], row["pid"], row["block"]):
            last = kept[0]["conv_id"] != row["conv_id"]
            conversation = conversation or Conversation(kept[0]["conv_id"])
            yield conversation, conversation.block(kept, last), last
            kept, conversation = [], None if last else conversation
        kept.append(row)
    if kept:
        conversation = conversation or Conversation(kept[0]["conv_id"])
        yield conversation, conversation.block(kept, True), True


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most BLOCK rows and about CHARACTERS characters of text."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += len(row.get("text") or row.get("audit") or "")
        if len(kept) >= BLOCK or held >= CHARACTERS:
            yield pa.RecordBatch.from_pylist(kept, schema=schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=schema)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    audit, digest, turns = [], hashlib.sha256(), 0
    for conversation, edits, last in _conversations(batches):
        for edit in edits:
            audit.append(edit["edit"])
            if edit["role"] is not None:
                digest.update(f"{chr(10) if turns else ''}{edit['role']}:{edit['text']}".encode())
                turns += 1
        if last:
            yield conversation.result(audit, digest.hexdigest())
            audit, digest, turns = [], hashlib.sha256(), 0


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for _, edits, _ in _conversations(batches):
        yield from edits


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "place long, edit string, role string, text string"


def _ordered(conversations: DataFrame) -> DataFrame:
    """The rows after damage, each conversation in order in one partition, with the costs to go at its blocks' ends."""
    many = partitions(conversations.sparkSession)
    rows = faults(damaged(conversations))
    keys = ["conv_id", "turn", "role", "body"]
    dealt = rows.repartitionByRange(many, *keys).sortWithinPartitions(*keys).select(*ROW).withColumn("pid", F.spark_partition_id())
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = conversations.schema["turn"].dataType.simpleString()
    numbered = dealt.mapInArrow(
        returning(_numbered), f"conv_id {kind}, turn {turn}, role string, text string, copies long, blank boolean, duplicate boolean, truncated boolean, pid int, block long, place int, costs array<long>"
    )
    stored = materialise(numbered, "turns")
    sums = stored.where("place = -1").select("conv_id", "pid", "block", "costs").repartition(many, "conv_id").sortWithinPartitions("conv_id", F.desc("pid"), F.desc("block"))
    ends = sums.mapInArrow(_ends, "pid int, block long, ends array<long>")
    turns = stored.where("place >= 0").drop("costs").join(ends, ["pid", "block"], "left")
    return turns.repartition(many, "conv_id").sortWithinPartitions("conv_id", "pid", "block", "place")


def _mapped(conversations: DataFrame, of, columns: str) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(n, to_arrow_type(kind) if n == "conv_id" else pa.int64() if c.endswith("long") else pa.string()) for n, c in zip(names, schema.split(", "))])
    return _ordered(conversations).mapInArrow(returning(lambda batches: _batched(of(batches), arrow)), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of
    conversations (conv_id, turn, role, text) after damage."""
    return _mapped(conversations, _results, RESULT)


def edited_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (its initial), role and text (null where a turn is deleted): the edits in order, so that
    the rows with a role are the repaired turns."""
    return _mapped(conversations, _edits, EDITS)


def query(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))
