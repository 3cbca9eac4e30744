"""Which texts hold which quotes, decided inside each text's row: nothing is exploded, and texts aren't shuffled.

Quotes whose size is checked and small travel to the texts. A quote's first and last word may be part of a longer one in
the text; all between stand there whole, so three of these with what is between them, the least by hash, are the quote's
anchor. Anchors lie in a Bloom filter: a text hashes each three of its words, bytes at a time, and only those that pass the
filter are looked up and compared, letter by letter. Quotes without three inner words go through an automaton that finds
all of them in one reading of the text. Quotes beyond that size meet the texts in a join on such hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an anchor.
WORDS = 3
#: Bytes of quotes that travel to the texts; and of those for one automaton, which holds some 40 bytes for each.
MOST_BYTES, SHORT_BYTES = 1 << 25, 1 << 20
#: Filter bits a quote, and how many of them it sets; bytes of text that are hashed at once.
BITS, PROBES, SLICE = 16, 4, 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def threes(data: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, starts and hashes of every three words in a row of texts data[offsets[i]:offsets[i + 1]]. Not whole:
    without a text's first and last word, which may be parts of longer ones."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    if not whole:
        first, last = np.r_[True, text[1:] != text[:-1]][: len(text)], np.r_[text[1:] != text[:-1], True][: len(text)]
        starts, ends, text = starts[~first & ~last], ends[~first & ~last], text[~first & ~last]
    n = max(0, len(starts) - WORDS + 1)
    same = np.flatnonzero(text[:n] == text[WORDS - 1 :])
    a, b = starts[same], ends[same + WORDS - 1]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return text[same], a, _mix((sums[b] - sums[a]) * _powers(_INVERSE, len(data) + 1)[a] + (b - a).astype(U))


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of rows that make up about SLICE bytes, or of one longer row; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data, row = np.frombuffer(column.buffers()[2] or b"", np.uint8), 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Quotes:
    """Quotes (distinct, not empty), numbered as given, ready to be found in texts."""

    def __init__(self, quotes: list[str]):
        self.raw = [q.encode() for q in quotes]
        best: dict[int, tuple[int, int]] = {}
        for row, data, offsets in _slices(pa.array(quotes, pa.string())):
            for text, start, h in zip(*(x.tolist() for x in threes(data, offsets, False))):
                if row + text not in best or h < best[row + text][0]:
                    best[row + text] = (h, start - int(offsets[text]))
        order = sorted(best, key=lambda q: best[q][0])
        self.hashes = np.array([best[q][0] for q in order], U)
        self.anchored, self.at = order, [best[q][1] for q in order]
        self.mask = U((1 << max(6, (BITS * max(1, len(order)) - 1).bit_length())) - 1)
        self.filter = np.zeros((int(self.mask) + 1) // 64, U)
        for bit in self._bits(self.hashes):
            np.bitwise_or.at(self.filter, (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
        self.short = [i for i in range(len(quotes)) if i not in best]
        self.quotes = quotes

    def _bits(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The filter's bits of each hash."""
        step = (hashes >> U(32)) | U(1)
        for k in range(PROBES):
            yield (hashes + U(k) * step) & self.mask

    def automata(self) -> list[ahocorasick.Automaton]:
        """Of the short quotes, SHORT_BYTES for each."""
        made, size = [], SHORT_BYTES
        for i in self.short:
            if size + len(self.raw[i]) > SHORT_BYTES:
                made.append(ahocorasick.Automaton())
                size = 0
            made[-1].add_word(self.quotes[i], i)
            size += len(self.raw[i])
        for automaton in made:
            automaton.make_automaton()
        return made

    def anchored_in(self, column: pa.Array) -> Iterator[tuple[int, int]]:
        """(row, quote) of the quotes with anchors that rows of texts hold."""
        for row, data, offsets in _slices(column):
            text, start, hashes = threes(data, offsets, True)
            passed = np.ones(len(hashes), bool)
            for bit in self._bits(hashes):
                passed &= (self.filter[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1
            at = np.flatnonzero(passed)
            low, high = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
            raw, found = memoryview(data), set()
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for k in range(a, b):
                    q = self.anchored[k]
                    begin = int(start[i]) - self.at[k]
                    if (text[i], q) not in found and begin >= offsets[text[i]] and begin + len(self.raw[q]) <= offsets[text[i] + 1] and raw[begin : begin + len(self.raw[q])] == self.raw[q]:
                        found.add((text[i], q))
            yield from ((row + int(t), q) for t, q in sorted(found))


def _by_row(texts: DataFrame, quotes: list, kinds: str) -> DataFrame:
    distinct = list(dict.fromkeys(q["quote"] for q in quotes))
    place = {q: i for i, q in enumerate(distinct)}
    ids: list[list] = [[] for _ in distinct]
    for q in quotes:
        ids[place[q["quote"]]].append(q["quote_id"])
    known = Quotes(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = known.automata()
        for batch in batches:
            pairs = set(known.anchored_in(batch.column(1))) if known.anchored else set()
            if automata:
                for row, text in enumerate(batch.column(1)):
                    said = text.as_py() or ""
                    for automaton in automata:
                        pairs |= {(row, q) for _, q in automaton.iter(said)}
            every = [(row, q, i) for row, q in sorted(pairs) for i in ids[q]]
            if every:
                rows = batch.take(pa.array([row for row, _, _ in every]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([i for _, _, i in every]), rows.column(1), pa.array([distinct[q] for _, q, _ in every], pa.string())], names=["text_id", "quote_id", "text", "quote"])

    return texts.select("text_id", "text").mapInArrow(run, kinds)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _hashes(words: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    found = F.transform(places, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<bigint>"))


def _by_join(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes with three inner words, however many: texts are exploded into hashes of their threes, which meet the anchors."""
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    known = quotes.withColumn("words", _words(F.col("quote"))).select("quote_id", F.array_min(_hashes(inner, WORDS)).alias("hash"))
    hashes = texts.select("text_id", _words(F.col("text")).alias("words")).select("text_id", F.explode(F.array_distinct(_hashes(F.col("words"), WORDS))).alias("hash"))
    met = hashes.join(known, "hash").select("text_id", "quote_id")
    return met.join(quotes.select("quote_id", "quote"), "quote_id").join(texts, "text_id").where(F.expr("contains(text, quote)")).select("text_id", "quote_id", "text", "quote")


def holding(texts: DataFrame, quotes: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """text_id, quote_id, text, quote for texts (text_id, text) that contain quotes (quote_id, quote), letter by letter.

    Quotes of up to most_bytes in all are found in each text's own row. Beyond that, those with three inner words go by a
    join, and the others, most_bytes at a time, by further readings of the texts. Empty quotes are in no text. Rows of
    texts come as often as they are given where their quotes travel; a join takes text_id as unique.
    """
    known = quotes.where("quote <> ''").select("quote_id", "quote").withColumn("size", F.octet_length("quote"))
    kinds = f"text_id {texts.schema['text_id'].dataType.simpleString()}, quote_id {quotes.schema['quote_id'].dataType.simpleString()}, text string, quote string"
    total = known.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if total <= most_bytes:
        return _by_row(texts, known.collect(), kinds)
    long = F.size(_words(F.col("quote"))) >= WORDS + 2
    found = _by_join(texts, known.where(long))
    short = known.where(~long)
    parts = -(-short.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] // most_bytes)
    for part in range(parts):
        some = short.where(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part)
        found = found.unionByName(_by_row(texts, some.collect(), kinds))
    return found
