"""Suffix-array dedup (operator 12): bytes that are covered by a string of SPAN bytes which also starts elsewhere go.

Which two strings of SPAN bytes are equal is read off sorted suffixes. Sorting every suffix of the corpus would send SPAN
times its size, so suffixes are sorted at anchors: in each string of SPAN bytes the GRAM bytes with the least hash, the
first of equals. The anchor depends on the string alone, so equal strings have it at the same place, and what a text shows
around an anchor, SPAN - GRAM bytes before and SPAN bytes from it on, holds every such string.

1. Anchors of all texts; those whose GRAM bytes occur once in the corpus are dropped, by counts that are combined before
   they are sent.
2. Equal contexts of one gram become one, with a count; copies settle each other. Grams all of whose contexts are copied
   are done.
3. The other grams' contexts are cut from the texts. For each gram the suffixes that follow it and the reversed prefixes before it
   are sorted by deep-shallow sorting (suffix_order.py); strings that take j bytes before the anchor are equal where both
   orders keep two contexts together, j bytes on the left and SPAN - j on the right. All of them hold the anchor, so the
   bytes to remove around it are one span, given by the least and the greatest such j.
4. A gram with more than WIDE different contexts would be one large task: its strings are counted by hash instead, one row
   a j, in aggregates that are combined before they are sent. This is exact too, and no row is dropped.
5. Spans go to their texts and are merged there.

Grams, contexts and strings are compared by 64-bit hashes within one gram, texts by a 64-bit hash and their length.

Defined cases: null and empty texts, and those under SPAN bytes, have nothing to remove and find nothing. Rows that repeat
a text are copies of each other, whatever their ids, null ones too: of SPAN bytes and more, all of it goes. Rows are
returned as often as they come. A text of any length is read in pieces; a run of one byte repeats its own strings. Empty
tables give no rows. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_order
from .common import discard, materialise, partitions, returning, table
from .kernel import U, _power, mix, slices

SPAN, GRAM = 200, 64
BEFORE = SPAN - GRAM
#: Different contexts of one gram that one task sorts, some 270 bytes and about 1 KB of work each; windows of a text that are
#: hashed at once; rows sorted at once.
WIDE, PIECE, SORTED = 1 << 17, 1 << 20, 1 << 15

ANCHORS = "gram long, ctx long, h long, n int, pos int"
CONTEXTS = "gram long, ctx long, copies long, c long, before binary, after binary"
DECIDED = "gram long, ctx long, before int, after int"
_LENGTH, _LEFT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD6431)
_LOW = U(2**31 - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", len(data)), out=sums[1:])
    return sums


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes, context hashes and text numbers of the anchors of texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U), np.empty(0, np.int64)
    sums, down = _sums(data), _power("down", n + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = BEFORE + 1
    ranked = np.full(-(-len(grams) // width) * width, ~U(0))
    ranked[: len(grams)] = (grams & ~_LOW) | np.arange(len(grams), dtype=U)
    blocks = ranked.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - SPAN + 1
    least = np.minimum(since[:strings], upto[width - 1 : width - 1 + strings])
    edge = np.zeros(n + 1, np.int32)
    long_enough = np.diff(offsets) >= SPAN
    np.add.at(edge, offsets[:-1][long_enough], 1)
    np.add.at(edge, offsets[1:][long_enough] - SPAN + 1, -1)
    chosen = np.zeros(n, bool)
    chosen[(least[np.cumsum(edge[:strings]) > 0] & _LOW).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(offsets, at, "right") - 1
    start, end = np.maximum(offsets[text], at - BEFORE), np.minimum(offsets[text + 1], at + SPAN)
    ctx = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _LENGTH + (at - start).astype(U) * _LEFT)
    return at, grams[at], ctx, text


def _anchors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, places in the row's text, grams and contexts; texts of more than PIECE windows in pieces."""
    for lo, hi, data, offsets in slices(column, PIECE):
        if hi - lo > 1 or len(data) <= 2 * PIECE:
            at, gram, ctx, text = anchors(data, offsets)
            yield lo + text, at - offsets[text], gram, ctx
            continue
        last = -1
        for first in range(0, len(data) - SPAN + 1, PIECE):
            # contexts end at the text's ends, so a piece has a context's margin on both sides
            a, b = max(0, first - BEFORE), min(len(data), first + PIECE + SPAN + SPAN)
            at, gram, ctx, _ = anchors(data[a:b], np.array([0, b - a]))
            at = at + a
            # strings that begin in the margins choose anchors of the neighbouring pieces, some with cut contexts
            own = (at > last) & (at >= first) & (at - BEFORE < first + PIECE) & ((at + SPAN <= b) | (b == len(data)))
            if own.any():
                last = int(at[own][-1])
            yield np.full(int(own.sum()), lo), at[own], gram[own], ctx[own]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for row, pos, gram, ctx in _anchors_of(batch.column(2)):
            if len(row):
                arrays = [gram.view(np.int64), ctx.view(np.int64), h[row], n[row].astype(np.int32), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["gram", "ctx", "h", "n", "pos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of texts (text, at: structs of gram, ctx, copies, c, pos)."""
    for batch in batches:
        for row in range(batch.num_rows):
            data = memoryview(batch.column(0)[row].as_buffer())
            wanted = batch.column(1)[row].values
            pos = wanted.field("pos").to_pylist()
            for a in range(0, len(pos), 1 << 14):
                part = pos[a : a + (1 << 14)]
                arrays = [wanted.field(c).slice(a, len(part)) for c in ("gram", "ctx", "copies", "c")]
                before = pa.array([bytes(data[max(0, p - BEFORE) : p]) for p in part], pa.binary())
                after = pa.array([bytes(data[p + GRAM : p + SPAN]) for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, before, after], names=["gram", "ctx", "copies", "c", "before", "after"])


def _matrix(column: pa.Array, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of BEFORE bytes, zero-padded, and their lengths; reversed, they are read from their ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    lengths, steps = np.diff(offsets), np.arange(BEFORE)
    out = np.zeros((len(lengths), BEFORE), np.uint8)
    for a in range(0, len(lengths), 1 << 12):
        part = slice(a, a + (1 << 12))
        at = (offsets[1:, None][part] - 1 - steps) if reverse else (offsets[:-1, None][part] + steps)
        inside = steps < lengths[part, None]
        out[part][inside] = data[at[inside]]
    return out, lengths


def decide(gram: np.ndarray, copies: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the greatest and the least j of which the string of j bytes before the anchor and SPAN - j from it
    on stands elsewhere too; -1 and SPAN where there is none. left and right are matrices and lengths."""
    n = len(gram)
    group = np.unique(gram, return_inverse=True)[1]
    orders = [suffix_order.sort(matrix, lengths, group) for matrix, lengths in (left, right)]

    def classes(side: int, depth: int) -> np.ndarray:
        order, common = orders[side]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.r_[0, common < depth])
        return out

    low, high = BEFORE - np.minimum(right[1], BEFORE), np.minimum(left[1], BEFORE)
    copied = (copies > 1) & (low <= high)
    most, least = np.where(copied, high, -1), np.where(copied, low, SPAN)
    for steps, found, better in ((range(BEFORE, -1, -1), most, np.maximum), (range(BEFORE + 1), least, np.minimum)):
        worst = -1 if found is most else SPAN
        for j in steps:
            able = (low <= j) & (j <= high)
            if not (able & (found == worst)).any():
                continue
            pair = classes(0, j)[able] * n + classes(1, BEFORE - j)[able]
            order = np.argsort(pair)
            same = pair[order][1:] == pair[order][:-1]
            met = np.zeros(len(pair), bool)
            met[order[1:][same]] = True
            met[order[:-1][same]] = True
            at = np.flatnonzero(able)[met]
            found[at] = better(found[at], j)
    return most, least


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions on contexts that come in order of gram and ctx, those that are no copies; whole grams, SORTED rows and more
    at a time. A context comes twice where rows of documents are equal, its id included."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        gram, copies = columns["gram"].to_numpy(), columns["copies"].to_numpy()
        most, least = decide(gram, copies, _matrix(columns["before"], True), _matrix(columns["after"], False))
        found = np.flatnonzero((most >= 0) & (copies == 1))
        arrays = [columns["gram"].take(pa.array(found)), columns["ctx"].take(pa.array(found)), most[found].astype(np.int32), (SPAN - least[found]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], names=["gram", "ctx", "before", "after"])

    kept: list[pa.RecordBatch] = []
    held, last = 0, None
    for batch in batches:
        gram, ctx = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.r_[last != (gram[0], ctx[0]), (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])] if len(gram) else np.empty(0, bool)
        last = (gram[-1], ctx[-1]) if len(gram) else last
        kept.append(batch.filter(pa.array(new)))
        held += int(new.sum())
        if held >= SORTED:
            rows = pa.Table.from_batches(kept)
            gram = rows.column("gram").to_numpy()
            whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if whole:
                yield settle(rows.slice(0, whole))
            kept = rows.slice(whole).to_batches()
            held = len(rows) - whole
    if held:
        yield settle(pa.Table.from_batches(kept))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, ctx, copies, j and a hash of each string of SPAN bytes over the contexts' anchors."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 11):
            part = batch.slice(a, 1 << 11)
            (left, n_left), (right, n_right) = _matrix(part.column(4), True), _matrix(part.column(5), False)
            joined = np.concatenate([left[:, ::-1], right], axis=1)
            m = joined.shape[1]
            sums = np.zeros((len(joined), m + 1), U)
            np.cumsum((joined.astype(U) + U(1)) * _power("up", m), axis=1, out=sums[:, 1:])
            j = np.arange(BEFORE + 1)
            # a string with j bytes on the left starts at BEFORE - j and has BEFORE bytes besides the gram
            hashes = mix((sums[:, m - j] - sums[:, BEFORE - j]) * _power("down", m + 1)[BEFORE - j])
            row, col = np.nonzero((j <= n_left[:, None]) & (BEFORE - j <= n_right[:, None]))
            taken = [part.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(j[col].astype(np.int32)), pa.array(hashes[row, col].view(np.int64))], names=["gram", "ctx", "copies", "j", "string"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns of rows (doc_id, text, spans: a list of starts and ends, or null)."""
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "starts": [], "ends": []}
        for row in range(batch.num_rows):
            data = memoryview(batch.column(1)[row].as_buffer())
            spans = batch.column(2)[row]
            starts, ends = merged(spans.values) if spans.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            for name, value in zip(out, (len(data), int((ends - starts).sum()), len(starts), digest.hexdigest(), starts, ends)):
                out[name].append(value)
        spans = [pa.array(out.pop(name), pa.list_(pa.int64())) for name in ("starts", "ends")]
        arrays = [batch.column(0), *[pa.array(out[name], pa.string() if name == "kept_sha256" else pa.int64()) for name in out], *spans]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out, "starts", "ends"])


def merged(spans: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans (start, end), in order; spans that touch are one."""
    starts, ends = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]


def repeated_spans(documents: DataFrame) -> DataFrame:
    """h, n (hash and bytes of a text) and spans (structs of start, end, unmerged) of the texts of documents (h, n, doc_id,
    text) that have any."""
    spark = documents.sparkSession
    many = partitions(spark)
    long_enough = documents.where(F.col("n") >= SPAN)
    found = long_enough.select("h", "n", "text").mapInArrow(returning(_anchor_rows), ANCHORS)
    # sent once more, so that a gram that is in very many texts can be split over tasks in the join
    repeated = found.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram").repartition("gram")
    shared = materialise(found.join(repeated, "gram", "left_semi"), "suffix-anchors")

    one = F.min(F.struct("h", "n", "pos"))
    contexts = materialise(shared.groupBy("gram", "ctx").agg(F.count("*").alias("copies"), one.alias("at")).select("gram", "ctx", "copies", "at.*"), "suffix-contexts")
    settled = contexts.where("copies > 1").select(
        "gram", "ctx", F.least("pos", F.lit(BEFORE)).alias("before"), F.least(F.col("n") - F.col("pos"), F.lit(SPAN)).alias("after")
    )
    # one row of each text stands for its copies
    row = F.struct("gram", "ctx", "copies", "c", "pos")
    unsettled = contexts.groupBy("gram").agg(F.count("*").alias("c"), F.min("copies").alias("least")).where("c > 1 and least = 1").drop("least")
    wanted = contexts.join(unsettled, "gram").groupBy("h", "n").agg(F.collect_list(row).alias("at"))
    bearer = long_enough.groupBy("h", "n").agg(F.min("doc_id").alias("bearer"))
    wanted = wanted.join(bearer, ["h", "n"]).withColumnsRenamed({"h": "_h", "n": "_n"})
    here = (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("bearer"))
    cut = materialise(long_enough.join(wanted, here).select("text", "at").mapInArrow(returning(_cut), CONTEXTS), "suffix-bytes")

    narrow = cut.where(F.col("c") <= WIDE).repartition(many, "gram").sortWithinPartitions("gram", "ctx")
    by_order = narrow.mapInArrow(returning(_sorted_groups), DECIDED)
    strings = cut.where(F.col("c") > WIDE).mapInArrow(returning(_strings), "gram long, ctx long, copies long, j int, string long")
    twice = strings.groupBy("gram", "j", "string").agg(F.sum("copies").alias("times")).where("times > 1").select("gram", "j", "string")
    by_count = strings.where("copies = 1").join(twice, ["gram", "j", "string"], "left_semi").groupBy("gram", "ctx").agg(F.max("j").alias("before"), (F.lit(SPAN) - F.min("j")).alias("after"))

    decided = settled.unionByName(by_order).unionByName(by_count)
    spans = shared.join(decided, ["gram", "ctx"]).select("h", "n", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))
    gathered = materialise(spans.distinct().groupBy("h", "n").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "suffix-spans")
    for used in (shared, contexts, cut):
        discard(used)
    return gathered


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (of the removed runs, in bytes) of documents (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), text.alias("text"))
    spans = repeated_spans(rows)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return rows.join(spans, ["h", "n"], "left").select("doc_id", "text", "spans").mapInArrow(returning(_keep), schema)


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
