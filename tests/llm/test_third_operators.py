"""Whitening, suffix dedup and turn repair against brute force, on odd rows and on whole driver tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lakebrook.llm import queries, suffix_dedup, suffix_order, turn_repair, whitening

SF = "/root/testdata/sf0.001"


# operator 11


def brute_whitening(rows, components=4):
    xs = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    away = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    values, vectors = values[order], vectors[:, order].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    out = {}
    for i, x in xs:
        a = [n * x[j] - sums[j] for j in range(d)]
        w = np.array([float(Fraction(q, n)) for q in a]) @ vectors.T / np.sqrt(values)
        for k in range(len(values)):
            out[i, k + 1] = (n, sum(q * q for q in a), w[k], values[k] / np.trace(cov))
    return out


def same_whitening(got, want):
    assert got.keys() == want.keys()
    for k, (n, deviation, whitened, explained) in want.items():
        assert (got[k][0], int(got[k][1])) == (n, deviation)
        assert abs(got[k][2] - whitened) < 1e-9 and abs(got[k][3] - explained) < 1e-12 and got[k][4] < 1e-4


@pytest.mark.parametrize("offset, scale", [(0, 1), (1e6, 1), (3e11, 1e10), (0, 1e-3)])
def test_whitening_equals_brute_force(spark, offset, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=7) * scale * np.arange(1, 8) + offset]) for i in range(200)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(100)]  # copies count once in the fit
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [float("nan")] * 7), (2003, [float("-inf")] * 7), (2004, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, x int, component int").repartition(13)
    same_whitening({(r.vec_id, r.component): (r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(df).collect()}, brute_whitening(rows))


def test_whitening_of_a_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {(r.vec_id, r.component): (r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in queries.QUERIES["op11_whitening"](spark, SF).collect()}
    same_whitening(got, brute_whitening(rows))


def test_whitening_without_variance_and_of_several_dimensions(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert of([]) == [] and of([(1, []), (2, None)]) == []
    assert [(r.component, r.whitened, r.explained, r.identity_error) for r in of([(1, [1.0, 2.0])])] == [(1, None, None, 0.0), (2, None, None, 0.0)]
    rows = of([(1, [1.0]), (2, [2.0]), (None, [1.0, 5.0]), (None, [1.0, 5.0]), (None, [1.0, 7.0]), (None, [3.0, 7.0])])
    assert {(r.vec_id, r.n, r.whitened) for r in rows if r.vec_id} == {(1, 2, -1.0), (2, 2, 1.0)}
    assert sorted((r.component, r.n) for r in rows if r.vec_id is None) == [(1, 3)] * 4 + [(2, 3)] * 4


def test_states_merge_to_the_state_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**9), 10**9, (500, 5)) + 10**15
    whole = whitening.state_of(x)
    parts = functools.reduce(whitening.State.merge, [whitening.state_of(x[a : a + 37]) for a in range(0, 500, 37)])
    assert parts.n == whole.n and parts.sums == whole.sums == [int(s) for s in x.astype(object).sum(axis=0)]
    assert np.allclose(parts.scatter, whole.scatter, rtol=1e-12)


# operator 12


def brute_dedup(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def odd_texts(seed):
    rng = random.Random(seed)

    def words(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    common = [words(n) for n in (199, 200, 201, 260, 700, 120, 64, 70)]
    texts = [None, "", "x" * 3000, "ab" * 700, "x" * 199, "x" * 200, "é" * 150, "\0" * 300]
    for _ in range(100):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(words(rng.randint(0, 300)))
            if rng.random() < 0.8:
                parts.append(rng.choice(common)[rng.choice([0, 0, 1, 2, 3]) :])
        texts.append("".join(parts))
    texts += texts[10:14] * 3
    base = list(words(2000))
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(2000)] = rng.choice("XYZ")
        texts.append("".join(copy))
    return [*texts, (words(20000) + "".join(base)) * 2, "".join(base[:500]) + "\0" * 250]


@pytest.mark.parametrize("seed, wide, piece", [(1, 4096, 1 << 20), (2, 3, 1 << 12), (3, 20, 1 << 10)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, seed, wide, piece):
    """Null ids, repeated rows, runs of one byte, strings one byte under the limit; wide grams; texts in pieces."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = odd_texts(seed)
    rows = [(i if i % 7 else None, t, 3, "z") for i, t in enumerate(texts)] + [(5, texts[40], 3, "z")] * 3
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, n int, gram string"))
    want = [((r[0] if r[0] is not None else -1), *b) for r, b in zip(rows, brute_dedup([r[1] for r in rows]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 50


def test_suffix_dedup_of_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute_dedup([r.text for r in rows])))


def test_suffix_dedup_of_nothing(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.dedup(spark.createDataFrame([], schema)).count() == 0
    rows = suffix_dedup.dedup(spark.createDataFrame([(None, None), (1, "")], schema)).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [(0, 0, 0, hashlib.sha256().hexdigest())] * 2


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sorting_equals_plain_sorting(seed):
    rng = random.Random(seed)
    width, strings = 120, []
    for _ in range(400):
        base = rng.choice(strings)[0] if strings and rng.random() < 0.8 else bytes(rng.choices(b"ab\0", k=width))
        cut = bytearray(base)
        if len(cut) and rng.random() < 0.7:
            cut[rng.randrange(len(cut))] = rng.choice(b"abc\0")
        strings.append((bytes(cut[: rng.choice([len(cut), rng.randint(0, len(cut))])]), rng.randrange(5)))
    matrix = np.zeros((len(strings), width), np.uint8)
    for i, (s, _) in enumerate(strings):
        matrix[i, : len(s)] = np.frombuffer(s, np.uint8)
    group = np.array([g for _, g in strings])
    order, common = suffix_order.sort(matrix, np.array([len(s) for s, _ in strings]), group)
    placed = [strings[i] for i in order]
    assert sorted(order) == list(range(len(strings)))
    assert [(g, s.ljust(width, b"\0"), len(s)) for s, g in placed] == sorted((g, s.ljust(width, b"\0"), len(s)) for s, g in strings)
    for (a, ga), (b, gb), c in zip(placed, placed[1:], common):
        shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == (shared if ga == gb else -1)


# operator 13

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if rule:
            text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
            kept += [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def brute_faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        found.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def brute_repair(rows, insert=5):
    """All edits from each place and state on, least cost and then least audit."""
    found = brute_faults(rows)

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in "03" else []
        if i < len(rows):
            _, role, text = rows[i]
            stays = 5 if found[i] == "truncated" else 0
            cost, audit, turns = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, turns))
            if found[i] not in ("blank", "duplicate"):
                for name, initial, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, name[:1]) in NEXT:
                        cost, audit, turns = best(i + 1, NEXT[state, name[:1]], 0)
                        options.append((cost + price + stays, initial + audit, ((name, text), *turns)))
        if inserted < 4:
            for name in ("user", "assistant"):
                if (state, name[0]) in NEXT:
                    cost, audit, turns = best(i, NEXT[state, name[0]], inserted + 1)
                    options.append((cost + insert, "I" + audit, ((name, ""), *turns)))
        return min(options, key=lambda o: o[:2]) if options else (1 << 40, "", ())

    cost, audit, turns = best(0, "0", 0)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
    initials = [r[1][:1] for r in rows]
    numbers = {r[0] for r in rows} - {None}
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    )


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            text = rng.choice(["Hi.", "Ok!", "so", "a.", "   ", None, "", "x? \n", "y.z", f"B.{rng.randint(0, 99)}"])
            rows.append((conv or None, None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * rng.randint(0, 3), role, text))
            rows += [rows[-1]] * (rng.random() < 0.1)
    return rows + [(9999, i // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", "so", "a.", f"t{i}."])) for i in range(200)]


@pytest.mark.parametrize("block, characters", [(1024, 1 << 22), (3, 1 << 22), (1024, 1)])
def test_turn_repair_equals_plain_search(spark, monkeypatch, block, characters):
    """Nulls in every column, equal turn numbers, repeated rows, dropped conversations, a long one over many blocks."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "CHARACTERS", characters)
    rows = odd_conversations(4)
    want = {conv: brute_repair(kept) for conv, kept in brute_damage(rows).items()}
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, copies int, blank string")
    got = turn_repair.repair(df).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    if block == 3:
        edits = turn_repair.edited_turns(df).where("conv_id = 9999").orderBy("place").collect()
        assert "".join(e.edit for e in edits) == want[9999][6]
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in edits if e.role is not None).encode()).hexdigest() == want[9999][7]


def test_turn_repair_of_a_whole_table_and_of_nothing(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = {conv: brute_repair(kept) for conv, kept in brute_damage(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_turn_repair"](spark, SF).collect()} == want
    assert turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_dropped_conversation_stays_with_zeros(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_the_walk_inserts_where_that_is_cheapest(monkeypatch):
    monkeypatch.setitem(turn_repair.COST, "I", 1)
    monkeypatch.setattr(turn_repair, "END", (0, 2, 1, 0))
    rng = random.Random(8)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"c{k}.", ""])) for k in range(rng.randint(0, 9))]
        found = brute_faults(rows)
        turns = [(r[1][:1], f in ("blank", "duplicate"), 5 if f == "truncated" else 0, 1) for r, f in zip(rows, found)]
        edits, _ = turn_repair.walk(turns, 0, turn_repair.END, True)
        assert "".join(e for _, e, _ in edits) == brute_repair(rows, insert=1)[6]
