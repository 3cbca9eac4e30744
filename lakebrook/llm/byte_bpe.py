"""Byte-level BPE encoding and decoding (operator 7).

Encoding compiles the merges into a finite-state transducer that is determinised lazily: a state is the longest end of
the text that some token starts with, and, for each place in it from which a later token could still start, the token
that ends there. A byte leads to the next state and puts out the one token that ends the encoding of the text so far:
the longest candidate that stands next to its predecessor without a merge across them (which is asked of the merges
themselves, once for each pair). The encoding is read back from the last put-out token; in long matches it is settled
every WINDOW bytes up to the last place that all live ends of the state have in common, so lookahead stays bounded.

Decoding looks tokens up and, for text, runs an incremental UTF-8 state machine that keeps an unfinished character of at
most three bytes between calls; invalid bytes become U+FFFD. The hash of the decoded bytes is of what the machine takes in,
and n_decoded counts the characters it puts out.

Defined cases: null texts are encoded as empty: no tokens, the hash of no bytes. Repeated rows are all kept; an empty
table gives no rows; extra columns are passed over. Texts of any length are read in runs of matches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import returning, table

RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 4096
#: Memory bounds of each Python worker: states of the transducer, pairs of tokens, matches with known ids.
MOST_STATES, MOST_PAIRS, MOST_MATCHES = 200_000, 1_000_000, 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.starts = {t[:i] for t in ranks for i in range(len(t))}  # what a longer token starts with
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        """A state: the longest end of the text that a longer token starts with, then distances and the ids of the tokens that end there (-1: the start), in turn."""
        self._index: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._next: list[dict[int, tuple[int, int]]] = []
        self._ends: dict[bytes, tuple[bytes, list[tuple[int, int]], frozenset[int]]] = {}
        self._state((b"", 0, -1))

    def _state(self, state: tuple) -> int:
        at = self._index.get(state)
        if at is None:
            at = self._index[state] = len(self._states)
            self._states.append(state)
            self._next.append({})
        return at

    def _end(self, whole: bytes) -> tuple[bytes, list[tuple[int, int]], frozenset[int]]:
        """The longest end of whole that a longer token starts with, the tokens that end it, and the sizes of such ends."""
        found = self._ends.get(whole)
        if found is None:
            n = len(whole)
            tokens = [(n - i, self.ranks[whole[i:]]) for i in range(n) if whole[i:] in self.ranks]
            sizes = [n - i for i in range(n) if whole[i:] in self.starts]
            found = self._ends[whole] = (whole[n - sizes[0] :] if sizes else b"", tokens, frozenset(sizes))
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """The merges themselves: the adjacent pair of lowest rank, leftmost first, until none is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stand(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            left, right = self.bytes_of[a], self.bytes_of[b]
            known = self._pairs[a, b] = left + right not in self.ranks and self.merged(left + right) == [left, right]
        return known

    def _step(self, at: int, byte: int) -> tuple[int, int]:
        state = self._states[at]
        longest, tokens, ends = self._end(state[0] + bytes((byte,)))
        before = dict(zip(state[1::2], state[2::2]))
        for size, last in tokens:
            ahead = before.get(size - 1)
            if ahead is not None and (ahead < 0 or self._stand(ahead, last)):
                break
        else:
            raise ValueError("the ranks don't cover every byte")
        kept = [longest, 0, last]
        for back, token in before.items():
            if back + 1 in ends:
                kept += (back + 1, token)
        found = self._next[at][byte] = (self._state(tuple(kept)), last)
        return found

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if len(self._states) > MOST_STATES:
            self._reset()
        if len(data) > WINDOW:
            return [t for ended in self._settled(data) for t in self._read_back(ended)]
        at, ended, following = 0, [], self._next
        for byte in data:
            found = following[at].get(byte)
            at, token = found if found is not None else self._step(at, byte)
            ended.append(token)
        return self._read_back(ended)

    def _read_back(self, ended: list[int]) -> list[int]:
        out, i, size = [], len(ended), self.size_of
        while i:
            token = ended[i - 1]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def _settled(self, data: bytes) -> Iterator[list[int]]:
        """Runs of the tokens ending at each byte; each run starts and ends where the encoding has a boundary."""
        at, ended = 0, []
        for byte in data:
            found = self._next[at].get(byte)
            at, token = found if found is not None else self._step(at, byte)
            ended.append(token)
            if not len(ended) % WINDOW and (common := self._common(at, ended)):
                yield ended[:common]
                ended = ended[common:]
        if ended:
            yield ended

    def _common(self, at: int, ended: list[int]) -> int:
        """The last boundary that lies on the way back from every place where a later token may start."""
        ways = []
        for back in self._states[at][1::2]:
            i, way = len(ended) - back, set()
            while i > 0:
                way.add(i)
                i -= self.size_of[ended[i - 1]]
            ways.append(way)
        return max(set.intersection(*ways), default=0)


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any cuts, get text; at most three bytes wait between calls."""

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many last bytes begin a character that isn't whole yet."""
        for n in range(1, min(3, len(data)) + 1):
            b = data[-n]
            if b & 0xC0 != 0x80:
                need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
                if need <= n:
                    return 0
                try:  # a tail that no further bytes can mend isn't kept
                    data[-n:].decode("utf-8")
                except UnicodeDecodeError as e:
                    return n if e.reason == "unexpected end of data" else 0
        return 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.waiting + data
        keep = 0 if final else self._unfinished(data)
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


class Codec:
    """Encoding and decoding of whole texts, with known matches at hand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).finditer
        self.split = regex.compile(pattern).findall
        self.tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.known = _Known(self.transducer)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > MOST_MATCHES:
            self.known.clear()
        get = self.known.__getitem__
        if len(text) <= 1 << 20:
            return b"".join(map(get, self.split(text)))
        matches, out = (m.group() for m in self.find(text)), []
        while run := list(islice(matches, 1 << 16)):
            out.append(b"".join(map(get, run)))
            if len(self.known) > MOST_MATCHES:
                self.known.clear()
        return b"".join(out)

    def decode(self, ids: bytes, run: int = 1 << 16) -> Iterator[bytes]:
        token = self.tokens.__getitem__
        all_ids = np.frombuffer(ids, "<u4")
        for i in range(0, len(all_ids), run):
            yield b"".join(map(token, all_ids[i : i + run].tolist()))

    def decode_text(self, runs: Iterable[bytes]) -> Iterator[str]:
        machine = Utf8Machine()
        for ids in runs:
            for part in self.decode(ids):
                yield machine.feed(part)
        yield machine.feed(b"", final=True)


class _Known(dict):
    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.transducer.encode(match.encode("utf-8")), "<u4").tobytes()
        if len(match) <= 64:
            self[match] = ids
        return ids


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_decoded of every row."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_hash, text_hash, out = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                machine = Utf8Machine()
                h, chars = hashlib.sha256(), 0
                # the hash is of what the machine hands on; a whole text's ids never make it replace anything
                for said in (*map(machine.feed, c.decode(ids)), machine.feed(b"", final=True)):
                    h.update(said.encode("utf-8"))
                    chars += len(said)
                text_hash.append(h.hexdigest())
                out.append(chars)
            columns = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded"])

    return documents.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded long")


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
