"""The index on storage: segments of chunks, sentences, posting blocks and term counts, one for each refresh.

A refresh writes the rows of changed items only; those of the others stay where they are. A version's items say which
segment holds their rows; items that a segment holds and the version doesn't are dead there, and their postings are passed
over. Term counts are a log of differences: a refresh adds what its items bring and takes away what its dead items had, so
that document frequencies are a sum over the questions' terms. compact() writes what is alive into one segment. Versions
are entries of a commit log (commits.py): readers see one whole or not at all, and of two refreshes at once one commits
while the other starts again from what the first one left.

A segment is cut into shards by item; within a shard chunks are numbered in order of their items. Postings lie in blocks of
up to 128 of one term and shard, in order of their terms, each with bounds on its gains. A search reads the row groups of
its terms once, and one task for each shard decides by the bounds which blocks it has to score (block_search.py).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import ACCENTS, porter, stem, tokens, without_accents
from ..sources.transcripts import strip
from .block_search import BLOCK, Shard, frontiers, gain
from .commits import CommitLog, attempt
from .index import LEAST_IDF, chunks_by_line, refresh_diff, terms_of
from .snippets import MARK, SENTENCE_END, told

INDEX_VERSION = 3
#: Up to so many different terms of a batch of questions are handed to the Parquet scan; more are joined.
PUSHED_TERMS = 1000
#: Lines of a shard, about, which bound a task's dense arrays; and below which a segment isn't cut to have more tasks.
SHARD_LINES, LEAST_LINES = 1 << 16, 1 << 12
#: Postings that are cut into blocks at once.
CUT = 1 << 16
ITEMS = ("evidence_id", "content_hash", "index_version", "segment", "shard", "item", "n_chunks", "n_words")
BLOCKS = "segment string, shard int, term string, first int, last int, n int, peak_tf array<int>, peak_dl array<int>, numbers array<int>, items array<int>, tf array<int>, dl array<int>"


class NewerIndex(Exception):
    """The folder was written by a later version of this engine."""


_PLAIN = str.maketrans(*ACCENTS)


def _stem(word: str) -> str:
    return porter(word if word.isascii() else word.translate(_PLAIN))


#: How words become terms: as a column of questions' words, and of one word of a chunk.
ANALYZERS = {"plain": (lambda c: c, lambda w: w), "stem": (lambda c: stem(without_accents(c)), _stem)}


def _counted(analyzer: str):
    """A function of rows (words, others) that gives others, term and tf: words are counted within their row, so that no
    term, however frequent, is gathered in one task. Each different word of a batch is analysed once."""
    of = ANALYZERS[analyzer][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, others = batch.column(0), batch.columns[1:]
            known = words.flatten().dictionary_encode()
            terms: dict[str, int] = {}
            codes = np.array([terms.setdefault(of(w), len(terms)) for w in known.dictionary.to_pylist()], np.int64)[known.indices.to_numpy()]
            row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
            found, tf = np.unique(row * max(1, len(terms)) + codes, return_counts=True)
            row, code = np.divmod(found, max(1, len(terms)))
            taken = [c.take(pa.array(row)) for c in others]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(list(terms), pa.string()).take(pa.array(code)), pa.array(tf, pa.int32())], names=[*batch.schema.names[1:], "term", "tf"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks of rows (segment, shard, term, number, item, tf, dl) in order of term, segment, shard and number."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, *[pa.list_(pa.int32())] * 6]
    schema = pa.schema(list(zip(names, types)))

    def new_runs(rows: pa.Table) -> np.ndarray:
        """Where another term or shard begins."""
        differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (rows.column("term").combine_chunks(), rows.column("shard").combine_chunks())]
        return np.flatnonzero(np.r_[True, differ[0] | differ[1]])

    def cut(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        within = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        edges = np.r_[np.flatnonzero(within % BLOCK == 0), len(rows)]
        at = pa.array(edges[:-1])
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        number, tf, dl = (columns[c].to_numpy() for c in ("number", "tf", "dl"))
        peak_tf, peak_dl, peak_edges = frontiers(tf, dl, edges)
        lists = lambda values, of: pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values, pa.int32()))
        plain = [columns["segment"].take(at), columns["shard"].take(at), columns["term"].take(at), number[edges[:-1]], number[edges[1:] - 1], np.diff(edges)]
        peaks = [lists(peak_tf, peak_edges), lists(peak_dl, peak_edges)]
        each = [lists(columns[c], edges) for c in ("number", "item", "tf", "dl")]
        return pa.RecordBatch.from_arrays([*[a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(plain, types)], *peaks, *each], schema=schema)

    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= CUT:
            rows = pa.Table.from_batches(kept)
            starts = new_runs(rows)
            # the last run may go on in the next batch; a long one goes on with a new block
            whole = int(starts[-1]) + (len(rows) - int(starts[-1])) // BLOCK * BLOCK
            if whole:
                yield cut(rows.slice(0, whole), starts[starts < whole])
            kept = rows.slice(whole).to_batches()
            held = len(rows) - whole
    if held:
        rows = pa.Table.from_batches(kept)
        yield cut(rows, new_runs(rows))


def _shard(blocks: pa.Table, dead: np.ndarray, average: float) -> Shard:
    """The blocks of one shard, in order of term and first chunk."""
    blocks = blocks.sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
    column = lambda name: blocks.column(name).combine_chunks() if blocks.num_rows else pa.array([], blocks.schema.field(name).type)
    flat = lambda name: column(name).flatten().to_numpy()
    peaks = gain(flat("peak_tf").astype(float), flat("peak_dl").astype(float), average)
    sizes = column("peak_tf").value_lengths().to_numpy()
    terms = column("term").to_pylist()
    new = [i for i, t in enumerate(terms) if i == 0 or t != terms[i - 1]]
    return Shard(
        [terms[i] for i in new], np.array([*new, len(terms)]), column("first").to_numpy(), column("last").to_numpy(),
        np.maximum.reduceat(peaks, np.cumsum(sizes) - sizes) if len(peaks) else peaks, np.r_[0, np.cumsum(column("n").to_numpy())],
        flat("numbers").astype(np.int64), flat("items").astype(np.int64), flat("tf"), flat("dl"), average, dead,
    )


class IndexStore:
    """An index at a path; its first refresh decides by which analyzers words become terms."""

    def __init__(self, spark: SparkSession, path: str, analyzers: tuple[str, ...] = ("stem",)):
        self.spark, self.path, self.analyzers = spark, path.rstrip("/"), analyzers
        self.log = CommitLog(spark, self.path)

    # what there is

    def current(self) -> dict[str, Any] | None:
        """The latest entry; None before the first refresh."""
        version = self.log.latest()
        return self._entry(version) if version else None

    def _entry(self, version: int) -> dict[str, Any]:
        entry = self.log.read(version)
        if entry["schema"] > INDEX_VERSION:
            raise NewerIndex(f"{self.path} has schema {entry['schema']}, this engine reads {INDEX_VERSION}")
        return entry

    def _there(self) -> dict[str, Any]:
        entry = self.current()
        if entry is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return entry

    def _items(self, entry: dict[str, Any]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items/{entry['items']}")

    def _rows(self, name: str, entry: dict[str, Any], segments: str = "segments") -> DataFrame:
        """All rows of the entry's segments, dead ones too."""
        parts = [self.spark.read.parquet(f"{self.path}/{name}/{s}") for s in entry[segments]]
        return reduce(DataFrame.unionByName, parts)

    def table(self, name: str, analyzer: str | None = None) -> DataFrame:
        """items, chunks (evidence_id, chunk_index, text, dl, low, high), sentences (evidence_id, k, sentence, low, high,
        next_low, next_high) or postings (term, evidence_id, chunk_index, dl, tf) of what is alive."""
        entry = self._there()
        items = self._items(entry)
        if name == "items":
            return items
        alive = items.select("evidence_id", "segment")
        if name != "postings":
            return self._rows(name, entry).join(alive, ["evidence_id", "segment"], "left_semi").drop("segment", "shard", "number", "item")
        each = F.explode(F.arrays_zip("numbers", "tf", "dl"))
        blocks = self._rows(f"blocks_{analyzer or self.analyzers[0]}", entry).select("segment", "shard", "term", each.alias("p"))
        places = self._rows("chunks", entry).select("segment", "shard", "number", "evidence_id", "chunk_index").join(alive, ["evidence_id", "segment"], "left_semi")
        rows = blocks.select("segment", "shard", "term", F.col("p.numbers").alias("number"), F.col("p.dl").cast("long").alias("dl"), F.col("p.tf").cast("long").alias("tf"))
        return rows.join(places, ["segment", "shard", "number"]).select("term", "evidence_id", "chunk_index", "dl", "tf")

    def blocks(self, analyzer: str | None = None) -> DataFrame:
        """Posting blocks (BLOCKS), those of dead items too."""
        return self._rows(f"blocks_{analyzer or self.analyzers[0]}", self._there())

    # writing

    def _write_segment(self, items: DataFrame, name: str) -> DataFrame:
        """Writes the segment of items (evidence_id, text); evidence_id, shard, item, n_chunks, n_words of those with chunks."""
        lines = items.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).alias("n")).first()["n"]
        shards = max(1, -(-lines // SHARD_LINES), min(self._many(), lines // LEAST_LINES))
        raw = chunks_by_line(items).withColumn("shard", F.pmod(F.xxhash64("evidence_id"), F.lit(shards)).cast("int"))
        size = F.length(strip(F.col("text")))
        in_shard, of_item = Window.partitionBy("shard").orderBy("evidence_id", "chunk_index"), Window.partitionBy("shard", "evidence_id").orderBy("chunk_index")
        low = F.coalesce(F.sum(F.when(size > 0, size + 1).otherwise(0)).over(of_item.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = raw.repartition(shards, "shard").withColumns({"low": low, "number": F.row_number().over(in_shard) - 1, "item": F.dense_rank().over(Window.partitionBy("shard").orderBy("evidence_id")) - 1})
        dl = F.size(tokens(F.col("text"))).cast("long")
        placed.withColumns({"segment": F.lit(name), "dl": dl, "high": F.col("low") + size}).write.parquet(f"{self.path}/chunks/{name}")
        chunks = self.spark.read.parquet(f"{self.path}/chunks/{name}")
        for analyzer in self.analyzers:
            rows = self._terms(chunks.withColumn("dl", F.col("dl").cast("int")), analyzer, "segment", "shard", "number", "item", "dl")
            # a term's postings of one shard are few enough for a task, however frequent the term is
            dealt = rows.repartition(self._many(), "term", "shard").sortWithinPartitions("term", "shard", "number")
            dealt.mapInArrow(_blocks, BLOCKS).write.parquet(f"{self.path}/blocks_{analyzer}/{name}")
        self._sentences(chunks).withColumn("segment", F.lit(name)).write.parquet(f"{self.path}/sentences/{name}")
        return chunks.groupBy("evidence_id", "shard", "item").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_words"))

    def _many(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def _terms(chunks: DataFrame, analyzer: str, *keys: str) -> DataFrame:
        """keys, term, tf of chunks (text, keys)."""
        schema = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
        return chunks.select(tokens(F.col("text")).alias("words"), *keys).mapInArrow(_counted(analyzer), f"{schema}, term string, tf int")

    @staticmethod
    def _sentences(chunks: DataFrame) -> DataFrame:
        """Each item's sentences, by their places in the item's chunks joined by blanks; with the place of the next one."""
        ordered = F.sort_array(F.collect_list(F.struct("chunk_index", strip(F.col("text")).alias("text"))))
        whole = chunks.groupBy("evidence_id").agg(F.array_join(F.filter(F.transform(ordered, lambda c: c["text"]), lambda t: t != ""), " ").alias("text"))
        pieces = whole.select("evidence_id", F.posexplode(F.split(F.regexp_replace("text", SENTENCE_END, "$1" + MARK), MARK)).alias("at", "piece"))
        order = Window.partitionBy("evidence_id").orderBy("at")
        high = F.sum(F.length("piece")).over(order)
        spans = pieces.withColumn("high", high).withColumn("low", F.col("high") - F.length("piece")).withColumn("sentence", strip(F.col("piece"))).where("sentence <> ''")
        return spans.select("evidence_id", F.row_number().over(order).alias("k"), "sentence", "low", "high", F.lead("low").over(order).alias("next_low"), F.lead("high").over(order).alias("next_high"))

    def _write_terms(self, name: str, entry: dict[str, Any] | None, dying: DataFrame | None) -> None:
        """Chunks that each term came to and left with a refresh, and their sum: the segment's minus those of dying items
        (evidence_id, segment)."""
        for analyzer in self.analyzers:
            came = self.spark.read.parquet(f"{self.path}/blocks_{analyzer}/{name}").select("term", F.col("n").cast("long").alias("df"))
            if entry and dying is not None:
                dead = self._rows("chunks", entry).join(dying, ["evidence_id", "segment"], "left_semi").select("segment", "text")
                left = self._terms(dead, analyzer, "segment").select("term", F.lit(-1).cast("long").alias("df"))
                came = came.unionByName(left)
            came.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").sortWithinPartitions("term").write.parquet(f"{self.path}/terms_{analyzer}/{name}")

    def refresh(self, items: DataFrame) -> dict[str, int]:
        """items (evidence_id, text), ids being unique. Counts of inserted, updated, reused and deleted items."""
        return attempt(self.log, lambda base: self._refreshed(items, base))

    def _refreshed(self, items: DataFrame, base: int) -> tuple[dict[str, Any], dict[str, int]]:
        entry, name = (self._entry(base) if base else None), f"s{uuid.uuid4().hex}"
        new = items.select("evidence_id", "text", F.sha2("text", 256).alias("content_hash"), F.lit(INDEX_VERSION).alias("index_version"))
        if entry is None:
            nothing = {"segment": F.lit(""), "shard": F.lit(0), "item": F.lit(0), "n_chunks": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long")}
            old = new.limit(0).drop("text").withColumns(nothing)
        else:
            old = self._items(entry)
        refresh_diff(old.withColumn("has_chunks", F.col("n_chunks") > 0), new).write.parquet(f"{self.path}/actions/{name}")
        actions = self.spark.read.parquet(f"{self.path}/actions/{name}")
        counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        changed = actions.where("action in ('inserted', 'updated')")
        fresh = new.join(changed, "evidence_id", "left_semi")
        sizes = self._write_segment(fresh, name)
        dying = old.join(actions.where("action in ('updated', 'deleted')"), "evidence_id", "left_semi").where("n_chunks > 0")
        some_die = counts.get("updated", 0) + counts.get("deleted", 0) > 0
        self._write_terms(name, entry, dying.select("evidence_id", "segment") if some_die else None)
        if some_die:
            dying.select("segment", "shard", "item").write.parquet(f"{self.path}/dead/{name}")
        sized = fresh.drop("text").join(sizes, "evidence_id", "left").withColumn("segment", F.lit(name)).fillna(0, ["n_chunks", "n_words"])
        kept = old.join(actions.where("action = 'reused'"), "evidence_id", "left_semi")
        sized.select(*ITEMS).unionByName(kept.select(*ITEMS)).write.parquet(f"{self.path}/items/{name}")
        before = entry or {"segments": [], "terms": [], "dead": []}
        told = {k: counts.get(k, 0) for k in ("inserted", "updated", "reused", "deleted")}
        return self._made(name, [*before["segments"], name], [*before["terms"], name], before["dead"] + [name] * some_die, told), told

    def _made(self, name: str, segments: list[str], terms: list[str], dead: list[str], counts: dict[str, int]) -> dict[str, Any]:
        total = self.spark.read.parquet(f"{self.path}/items/{name}").agg(F.sum("n_chunks").alias("n"), F.sum("n_words").alias("w")).first()
        return {"schema": INDEX_VERSION, "items": name, "segments": segments, "terms": terms, "dead": dead, "n_chunks": total["n"] or 0, "n_words": total["w"] or 0, "counts": counts}

    def compact(self) -> None:
        """One segment of what is alive. Segments of earlier versions stay for their readers."""

        def work(base: int) -> tuple[dict[str, Any], None]:
            entry, name = self._entry(base), f"s{uuid.uuid4().hex}"
            items = self._items(entry)
            alive = self._rows("chunks", entry).join(items.select("evidence_id", "segment"), ["evidence_id", "segment"], "left_semi")
            # line breaks stand for the lines without words, so that chunks keep their numbers
            ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
            lines = F.transform(F.sequence(F.lit(0).cast("long"), F.array_max(F.transform("lines", lambda c: c["chunk_index"]))), lambda i: F.coalesce(F.element_at("by_line", i), F.lit("")))
            texts = alive.groupBy("evidence_id").agg(ordered.alias("lines")).withColumn("by_line", F.map_from_entries("lines")).select("evidence_id", F.array_join(lines, "\n").alias("text"))
            sizes = self._write_segment(texts, name)
            self._write_terms(name, None, None)
            kept = items.select("evidence_id", "content_hash", "index_version").join(sizes, "evidence_id", "left").withColumn("segment", F.lit(name)).fillna(0, ["n_chunks", "n_words"])
            kept.select(*ITEMS).write.parquet(f"{self.path}/items/{name}")
            return self._made(name, [name], [name], [], {}), None

        attempt(self.log, work)

    # reading

    def _asked(self, queries: DataFrame, entry: dict[str, Any], analyzer: str) -> tuple[DataFrame, list[str] | None]:
        """query_id, term, idf of queries (query_id, query), of terms that the index has; and the terms, where they are few."""
        words = terms_of(queries).withColumnRenamed("term", "word")
        wanted = words.select("query_id", ANALYZERS[analyzer][0](F.col("word")).alias("term")).distinct()
        few = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        known = self._rows(f"terms_{analyzer}", entry, "terms")
        known = known.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else known.join(wanted.select("term").distinct(), "term", "left_semi")
        df = known.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.greatest(F.log((F.lit(entry["n_chunks"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        return wanted.join(df, "term").select("query_id", "term", idf.alias("idf")), few if len(few) <= PUSHED_TERMS else None

    def _shards(self, queries: DataFrame, analyzer: str | None, of, columns: str) -> tuple[DataFrame, dict[str, Any]]:
        """of(shard, {query: [(term, idf)]}) for each shard that has terms of the queries; with its segment and shard."""
        entry = self._there()
        analyzer = analyzer or self.analyzers[0]
        asked, few = self._asked(queries, entry, analyzer)
        blocks = self._rows(f"blocks_{analyzer}", entry)
        blocks = blocks.where(F.col("term").isin(few)) if few is not None else blocks.join(asked.select("term").distinct(), "term", "left_semi")
        average = entry["n_words"] / max(1, entry["n_chunks"])
        schema = pa.schema([("segment", pa.string()), ("shard", pa.int32()), *[(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}.get(c.split()[1]) or to_arrow_type(queries.schema["query_id"].dataType)) for c in columns.split(", ")]])
        ddl = "segment string, shard int, " + ", ".join(f"{c.split()[0]} {queries.schema['query_id'].dataType.simpleString() if c.split()[1] == 'key' else c.split()[1]}" for c in columns.split(", "))
        here = blocks.select(F.col("segment").alias("segment"), F.col("shard").alias("shard")).distinct()
        # each shard is asked all questions; there are few shards, and the rows are terms, not texts
        sent = here.crossJoin(F.broadcast(asked)) if few is not None else here.crossJoin(asked)
        if entry["dead"]:
            gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/dead/{d}") for d in entry["dead"]])
            sent = sent.withColumn("item", F.lit(None).cast("int")).unionByName(gone.select("segment", "shard", "item"), allowMissingColumns=True)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            dead = right.column("item").drop_null().to_numpy() if "item" in right.column_names else np.empty(0, np.int64)
            by_query: dict[Any, list[tuple[str, float]]] = {}
            for query, term, idf in zip(right.column("query_id").to_pylist(), right.column("term").to_pylist(), right.column("idf").to_pylist()):
                if term is not None:
                    by_query.setdefault(query, []).append((term, idf))
            if not left.num_rows or not by_query:
                return schema.empty_table()
            shard = _shard(left, dead.astype(np.int64), average)
            found = of(shard, {q: sorted(terms) for q, terms in sorted(by_query.items())})
            n = len(found[0])
            place = [pa.array([left.column(c)[0].as_py()] * n, schema.field(c).type) for c in ("segment", "shard")]
            return pa.Table.from_arrays([*place, *[pa.array(v, schema.field(i + 2).type) for i, v in enumerate(found)]], schema=schema)

        key = ["segment", "shard"]
        return blocks.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, ddl), entry

    def _named(self, found: DataFrame, entry: dict[str, Any]) -> DataFrame:
        """found with evidence_id and chunk_index for segment, shard and number."""
        places = self._rows("chunks", entry).select("segment", "shard", "number", "evidence_id", "chunk_index")
        return found.join(places, ["segment", "shard", "number"]).drop("segment", "shard", "number", "item")

    def search(self, queries: DataFrame, analyzer: str | None = None) -> DataFrame:
        """query_id, evidence_id, chunk_index, score of every chunk that matches queries (query_id, query)."""

        def of(shard: Shard, asked: dict) -> list:
            found = [(q, *shard.all(terms)) for q, terms in asked.items()]
            return [_repeated([(q, n) for q, n, _, _ in found]), *_joined(found, 1, 3)]

        found, entry = self._shards(queries, analyzer, of, "query_id key, number int, score double")
        return self._named(found, entry).select("query_id", "evidence_id", "chunk_index", "score")

    def best(self, queries: DataFrame, per_item: int = 1, k: int | None = None, analyzer: str | None = None) -> DataFrame:
        """query_id, evidence_id, chunk_index, score, rank (in the item) of the per_item best chunks of each matching item,
        or of each query's k best items, ties to the smaller evidence_id. With k, and one chunk an item, blocks that can't
        hold any are passed over."""

        def of(shard: Shard, asked: dict) -> list:
            parts = []
            for query, terms in asked.items():
                if k is not None:
                    numbers, items, scores = shard.top(terms, k)
                    # items with the k-th best score are all kept: their ids decide, and only all shards together know k
                    if per_item > 1 and len(items):
                        wanted = np.unique(items)
                        numbers, items, scores = shard.all(terms)
                        inside = np.isin(items, wanted)
                        numbers, items, scores = numbers[inside], items[inside], scores[inside]
                else:
                    numbers, items, scores = shard.all(terms)
                order = np.lexsort((numbers, -scores, items))
                numbers, items, scores = numbers[order], items[order], scores[order]
                rank = np.arange(len(items)) - np.searchsorted(items, items) + 1
                kept = rank <= per_item
                parts.append((query, numbers[kept], items[kept], scores[kept], rank[kept]))
            return [_repeated([(q, n) for q, n, *_ in parts]), *_joined(parts, 1, 3, 4)]

        found, entry = self._shards(queries, analyzer, of, "query_id key, number int, score double, rank long")
        if k is None:
            return self._named(found, entry).select("query_id", "evidence_id", "chunk_index", "score", "rank")
        named = self._named(found, entry)
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("evidence_id"))
        if per_item == 1:
            return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "evidence_id", "chunk_index", "score", "rank")
        top = Window.partitionBy("query_id", "evidence_id")
        # an item's place is that of its best chunk
        placed = named.withColumn("most", F.max("score").over(top)).withColumn("place", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("most").desc(), F.col("evidence_id"))))
        return placed.where(F.col("place") <= k).select("query_id", "evidence_id", "chunk_index", "score", "rank")

    def top(self, queries: DataFrame, k: int, analyzer: str | None = None) -> DataFrame:
        """query_id, evidence_id, chunk_index, score, rank of each query's k best items by their best chunk."""
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("evidence_id"))
        return self.best(queries, 1, k, analyzer).withColumn("rank", F.row_number().over(order).cast("long"))

    def match_counts(self, queries: DataFrame, k: int, analyzer: str | None = None) -> DataFrame:
        """Matched chunks and items, returned items, and whether there were more; an item lies in one shard."""

        def of(shard: Shard, asked: dict) -> list:
            found = [(q, *shard.all(terms)[:2]) for q, terms in asked.items()]
            return [[q for q, _, _ in found], [len(n) for _, n, _ in found], [len(np.unique(i)) for _, _, i in found]]

        found, _ = self._shards(queries, analyzer, of, "query_id key, chunks long, items long")
        counts = found.groupBy("query_id").agg(F.sum("chunks").alias("matched_chunks"), F.sum("items").alias("matched_items")).where("matched_chunks > 0")
        returned = F.least(F.col("matched_items"), F.lit(k).cast("long"))
        return counts.select("query_id", "matched_chunks", "matched_items", returned.alias("returned"), (returned < F.col("matched_chunks")).alias("truncated"), (returned < F.col("matched_items")).alias("truncated_items"))

    def blocks_read(self, queries: DataFrame, k: int, analyzer: str | None = None) -> dict[str, int]:
        """How many blocks and postings the queries' terms have, counted for each query, and how many of them a search for
        k items scores."""

        def of(shard: Shard, asked: dict) -> list:
            for terms in asked.values():
                shard.top(terms, k)
            return [[next(iter(asked))], *[[n] for n in shard.counts.values()]]

        names = ("blocks", "read", "postings", "postings_read")
        found, _ = self._shards(queries, analyzer, of, "query_id key, " + ", ".join(f"{n} long" for n in names))
        return found.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()

    def excerpts(self, matched: DataFrame, most: int = 2400) -> DataFrame:
        """query_id, evidence_id, snippet for matched (query_id, evidence_id, chunk_index): the sentences that touch a
        matched chunk, each with the one before, by stored places; no text is read but these sentences."""
        entry = self._there()
        alive = self._items(entry).select("evidence_id", "segment")
        live = lambda name, *columns: self._rows(name, entry).select("evidence_id", "segment", *columns)
        # the matches are few and know their items' segments before anything larger is met
        here = matched.select("query_id", "evidence_id", "chunk_index").distinct().join(alive, "evidence_id")
        hit = live("chunks", "chunk_index", "low", "high").where("high > low").join(here, ["evidence_id", "segment", "chunk_index"])
        hit = hit.select("query_id", "evidence_id", "segment", F.col("low").alias("from"), F.col("high").alias("to"))
        touches = F.expr("(from < high and to > low) or (from < next_high and to > next_low)")
        wanted = live("sentences", "k", "sentence", "low", "high", "next_low", "next_high").join(hit, ["evidence_id", "segment"]).where(touches)
        return told(wanted.select("query_id", "evidence_id", "k", "sentence").distinct(), most)


def _repeated(parts: list[tuple[Any, np.ndarray]]) -> list:
    return [q for q, values in parts for _ in range(len(values))]


def _joined(parts: list[tuple], *columns: int) -> list[np.ndarray]:
    return [np.concatenate([p[c] for p in parts]) if parts else np.empty(0) for c in columns]
