"""Rules, classifier, tokenizers, packing and line dedup against brute force on small fixtures."""

import bisect
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakebrook.llm import byte_bpe, line_dedup, packing, quality_classifier, quality_rules
from lakebrook.llm.text_statistics import statistics
from lakebrook.llm.training import labelled_features

ODD = [None, "", " ", "\n\n", "a", "é b", "x\r\nx\r\n", "ab " * 10, "漢字 😀\tx\x0bz", "1 2 3 4 5 6 7 8 " * 3, "w" * 50_000, "so it goes on " * 20_000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], DOCS)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_equal_brute_force():
    texts = [t for t in ODD if t is None or len(t) < 60_000]
    counts, features = statistics(pa.array(texts))
    assert [tuple(c) for c in counts.tolist()] == [brute_counts(t) for t in texts]
    assert np.isfinite(features).all()


def test_rules_and_classifier_on_odd_rows(spark):
    good = [f"the river of {i} and its many towns lie along a wide valley with old farms and mills near {i} bridges and roads to the sea." for i in range(60)]
    bad = ["BUY NOW!!! $$$ " * 20 + str(i) for i in range(60)]
    docs = documents(spark, good + bad + ODD + ODD)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    forests = quality_rules.fitted(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, forests).collect()}
    assert len(rows) == docs.count()
    assert all(rows[i].kept for i in range(60)) and not any(rows[i].kept for i in range(60, 120))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows.values())
    assert not any(r.kept and r.base_failed for r in rows.values())
    model = quality_classifier.fitted(docs, labels)
    scores = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert all(scores[i].predicted == 1 for i in range(60)) and all(scores[i].predicted == 0 for i in range(60, 120))
    assert all(0 <= r.score <= 1 for r in scores.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores.values())
    kept = quality_classifier.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.predicted}


def test_fit_and_scores_equal_plain_sums_and_paths(spark):
    """The classifier's score is a sum of looked-up values, the forests' verdict a mean of path lengths; ids that repeat
    give one row of the sample."""
    texts = [f"the river of {i} and its towns lie along a wide valley with old farms and mills near {i} bridges and roads to the sea." for i in range(40)]
    texts += ["BUY NOW!!! $$$ " * 20 + str(i) for i in range(40)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    x, y = labelled_features(docs.unionByName(docs), labels, 1000)
    assert len(x) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(80))
    model = quality_classifier.fit(x, y)
    for row, score in zip(x, model.score(x)):
        z = model.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables))
        z += sum(t[sum(c <= row[i] for c in ci), sum(c <= row[j] for c in cj)] for i, j, ci, cj, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
    for forest in quality_rules.fit(x, y):
        values = quality_rules.drawn(x, forest.columns, forest.middle)
        for row, score in zip(values, forest.scores(x)):
            total = 0.0
            for feature, split, path in zip(forest.feature, forest.split, forest.path):
                at = 0
                while feature[at] >= 0:
                    at = 2 * at + 1 + int(row[feature[at]] >= split[at])
                total += path[at]
            assert abs(score - 2.0 ** (-total / (len(forest.path) * forest.normal))) < 1e-9


def test_thresholds_of_the_rules_come_from_every_labelled_row(spark, monkeypatch):
    """All good rows but the trees' own are counted, however many there are, and the count equals a plain sort."""
    monkeypatch.setattr(quality_rules, "TREES", 4)
    monkeypatch.setattr(quality_rules, "SUBSAMPLE", 16)
    texts = [f"the river of {i} and its {'TOWNS' if i % 7 == 0 else 'towns'} lie along a wide valley with {i * i} old farms and mills near {i} bridges and roads to the sea." for i in range(9000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9000)], "doc_id long, quality int, toxic int")
    x, _ = labelled_features(docs, labels, 9000)
    for forest in quality_rules.fitted(docs, labels):
        assert np.allclose(forest.middle, x[:, forest.columns].mean(axis=0), atol=1e-8)
        over = (forest.scores(x) > forest.threshold - quality_rules.MARGIN).sum()
        assert over <= quality_rules.FALSE_REJECTS * len(x) + 1


def test_models_without_labels_or_rows(spark):
    docs, none = documents(spark, ["a b c"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, quality_rules.fitted(docs, none)).count() == 1
    assert quality_classifier.score(docs, quality_classifier.fitted(docs, none)).first().score == 0.5
    empty = documents(spark, ["x"]).limit(0)
    assert quality_classifier.score(empty, quality_classifier.fitted(docs, none)).count() == 0


def test_classifier_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.query(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.95


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = byte_bpe.load_ranks(path)
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes(bpe):
    codec, library = bpe
    rng = np.random.default_rng(7)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "ß", "😀", "1", "23", "!", "...", "ing", "the", "\t", "漢", "'s"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(300)] + ["a" * 9000 + "é" * 5000 + " " * 5000]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert b"".join(codec.decode(ids)) == t.encode()
    ids = codec.encode("漢字é😀 ok" * 50)
    assert "".join(codec.decode_text(ids[i : i + 4] for i in range(0, len(ids), 4))) == "漢字é😀 ok" * 50


def test_utf8_machine_takes_any_cuts_and_invalid_bytes():
    data = "aé漢😀z".encode()
    for step in (1, 2, 3, 5):
        m = byte_bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.feed(b"", True) == "aé漢😀z"
    m = byte_bpe.Utf8Machine()
    assert m.feed(b"\xffa\xe6\xbc") + m.feed(b"", True) == "\ufffda\ufffd"


def test_byte_bpe_rows(spark):
    path = public_tokenizers.path(byte_bpe.RANKS)
    rows = byte_bpe.digests(documents(spark, [None, "", "ab cd", "ab cd"]), path, public_tokenizers.PATTERN).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == 0 and by[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == by[1].decoded_sha256
    assert by[2][1:] == by[3][1:] and by[2].decoded_sha256 == hashlib.sha256(b"ab cd").hexdigest()
    texts = ODD + ["漢字é😀 ok " * 50_000]
    clash = documents(spark, texts).selectExpr("doc_id", "text", "1 as n_tokens", "2 as ids_sha256", "3 as n_decoded")
    got = {r.doc_id: r for r in byte_bpe.digests(clash, path, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    assert all(got[i].n_decoded == len(t or "") and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))


def test_word_ids_equal_the_tokenizer():
    path = public_tokenizers.path(packing.VOCABULARY)
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = np.random.default_rng(3)
    parts = ["a", "E", "T", " ", "\n", "é", "1", "!", "Ing", "'s", "'", "Σ", "ΑΣ", "İ", "e\u0301", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "K", "\ufb01", "漢", "😀"]
    for t in ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(800)] + [t or "" for t in ODD if t is None or len(t) < 60_000]:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 5}, {2048: 7, 2049: 7}, {100: 4000, 333: 900, 1500: 400, 4096: 10}, {n: 1 + n % 3 for n in range(1, 4097, 7)}])
def test_plan_uses_every_piece_once_and_fits(histogram):
    sequences = placed_once(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    if max(histogram, default=0) < 2000:
        assert sequences <= 1.001 * tokens / 4096 + 2


def placed_once(histogram):
    plan, bound = packing.plan(histogram, 4096)
    used = Counter()
    for config, times in plan:
        assert times > 0 and sum(length * n for length, n in config) <= 4096
        for length, n in config:
            used[length] += n * times
    assert used == Counter(histogram)
    sequences = sum(times for _, times in plan)
    assert bound <= sequences + 1e-6
    return sequences


@pytest.mark.parametrize("times", [1, 100, 10_000])
@pytest.mark.parametrize("kind", ["text", "log-normal"])
def test_the_program_packs_all_pieces_at_every_size(kind, times):
    """The shares of the program, rounded, place each piece, and the number of columns doesn't grow with the counts."""
    rng = np.random.default_rng(4)
    sizes = np.exp(rng.normal(*((6, 1.2) if kind == "log-normal" else (5.4, 0.9)), 8000)).astype(int).clip(1, 4096)
    histogram = {int(k): int(v) * times for k, v in zip(*np.unique(sizes, return_counts=True))}
    least = -(-sum(k * v for k, v in histogram.items()) // 4096)
    assert placed_once(histogram) <= 1.001 * least + 1
    assert len(packing.plan(histogram, 4096)[0]) < 20 * len(histogram)


def best_fit_decreasing(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect.bisect_left(rooms, length)
            n += at == len(rooms)
            room = rooms.pop(at) if at < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return n


@pytest.mark.parametrize("low, high, n", [(1364, 2731, 1500), (1, 4096, 200), (1, 4096, 1000), (1000, 2000, 1000), (1300, 1500, 2000), (820, 1639, 800), (2000, 4096, 300), (500, 2500, 30)])
def test_the_program_needs_no_more_sequences_than_best_fit_decreasing(low, high, n):
    rng = np.random.default_rng(n)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(low, high + 1, n), return_counts=True))}
    needed = placed_once(histogram)
    _, bound = packing.plan(histogram, 4096)
    assert bound <= needed <= best_fit_decreasing(histogram, 4096)
    if low >= 2000:  # nearly all are longer than half a sequence: volume says little
        assert bound > -(-sum(k * v for k, v in histogram.items()) // 4096)


@pytest.mark.parametrize("seed", range(8))
def test_lower_bounds_hold(seed):
    """Against the fewest sequences found by trying all packings of a few pieces."""
    rng = np.random.default_rng(seed)
    pieces = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)

    def fewest(at, rooms):
        if at == len(pieces):
            return len(rooms)
        tried = [fewest(at + 1, rooms[:i] + [r - pieces[at]] + rooms[i + 1 :]) for i, r in enumerate(rooms) if r >= pieces[at] and r not in rooms[:i]]
        return min([*tried, fewest(at + 1, [*rooms, 20 - pieces[at]])])

    lengths, count = np.unique(pieces, return_counts=True)
    best = fewest(0, [])
    assert packing.threshold_bound(lengths, count, 20) <= best and packing.prices(lengths, count, 20)[1] <= best + 1e-6
    configurations, bound = packing.plan(dict(zip(lengths.tolist(), count.tolist())), 20)
    assert bound <= best <= sum(times for _, times in configurations) <= best + 1


def test_knapsack_equals_enumeration():
    lengths, worth = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.69])
    best, _ = packing._knapsack(lengths, worth, 20)
    for c in range(21):
        tried = [i * worth[0] + j * worth[1] + k * worth[2] for i in range(7) for j in range(5) for k in range(3) if 3 * i + 5 * j + 7 * k <= c]
        assert abs(best[c] - max(tried)) < 1e-9


def test_packing_rows(spark):
    texts = [None, "", "one two", "one two", "long words " * 3000] + [f"text number {i} " * (i % 40) for i in range(200)]
    rows = packing.pack(documents(spark, texts), public_tokenizers.path(packing.VOCABULARY)).collect()
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(ids), 4096))
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(documents(spark, ["x"]).limit(0), public_tokenizers.path(packing.VOCABULARY)).count() == 0


def brute_lines(rows, contexts):
    """Which lines go, by the definition, with whole strings for hashes: surroundings are compared, not ordered, so that
    fixtures give each document one other line at most."""
    keys = {}
    for doc, text in rows:
        lines = [re.sub(r"(?<!\S)\S*[0-9]\S*", "<*>", x).strip(" \t\r") for x in (text or "").split("\n")] if text is not None else []
        for at, x in enumerate(lines):
            n = x.count(" ") + 1
            if n < 3:
                continue
            words = x.split(" ")
            half = 3 + (n - 3) // 2
            ks = [(0, x)] + ([(1, n, tuple(words[:half])), (2, n, tuple(words[:3]), tuple(words[half:]))] if n >= 8 else [])
            others = tuple(sorted({y for y in lines if y and y != x}))
            for k in ks:
                keys.setdefault(k, []).append((doc, at, others))
    gone = set()
    for hits in keys.values():
        if len({o for _, _, o in hits}) >= contexts:
            first = min(d for d, _, _ in hits)
            gone |= {(d, at) for d, at, _ in hits if d != first}
    return gone


def test_line_dedup_equals_brute_force(spark):
    boiler = "all rights are reserved by us in the year {} for ever and ever"
    rows = [(i, boiler.format(2000 + i) + f"\nown story number {'abcdefghij'[i]} is told here") for i in range(10)]
    rows += [(20 + i, "the same page said twice over by copies\nwith one more line below") for i in range(8)]  # exact copies stay
    rows += [(40, None), (41, ""), (42, "ok"), (43, "\n\n"), (44, boiler.format(7) + "\n" + boiler.format(8))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 5) for d, t in rows], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    gone = brute_lines(rows, line_dedup.CONTEXTS)
    assert len(got) == len(rows) and gone
    for d, t in rows:
        want = None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone)
        assert got[d].text == want and got[d].key == 5, d
    assert all(got[20 + i].n_dropped == 0 for i in range(8)) and got[3].n_dropped == 1 and got[0].n_dropped == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as version", "2 as dropped", "3 as n_lines", "4 as line")
    again = line_dedup.dedup_lines(clash)
    assert again.columns == ["doc_id", "text", "version", "dropped", "line", "n_lines", "n_dropped"] and {r.doc_id: r.text for r in again.collect()} == {i: r.text for i, r in got.items()}


def test_short_lines_recur_too(spark):
    rows = [(i, f"Read more\nstory of {'abcdefghij'[i]} told here\n\nLes.\n{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert all(got[i].text == f"story of {'abcdefghij'[i]} told here\n" and got[i].n_dropped == 3 for i in range(1, 10))


def test_blocks_and_lines_of_few_documents_recur(spark):
    footer = "\n".join(f"footer line {c} of the house" for c in "abcdefghij")
    rows = [(i, f"own story {c} is told here\n{footer}") for i, c in enumerate("abcdefghijklmnopqrst")]
    rows += [(100, "a passage that two share\none tale"), (101, "another tale\na passage that two share")]
    rows += [(110 + i, "a text that is\nthere as copies") for i in range(8)] + [(118, "there as copies\na text that is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own story {'abcdefghijklmnopqrst'[i]} is told here" for i in range(1, 20))
    assert got[100] == "a passage that two share\none tale" and got[101] == "another tale"
    assert all(got[d] == t for d, t in rows if d >= 110)


def test_white_space_is_even_and_quarters_are_open(spark):
    gaps = [" ", "  ", "\t", "\u00a0", "\u3000", " \u2009\t", "\u202f"]
    rows = [(i, gap.join(["all", "rights", "are", "ours"]) + f"\ntale {c}") for i, (gap, c) in enumerate(zip(gaps, "abcdefg"))]
    rows += [(20 + i, f"漢字かな文。\ntale {c}") for i, c in enumerate("hij")]
    rows += [(30, "one two three k l m n o\ntale k"), (31, "one two three k l x y z\ntale l")]  # half is another: two lines
    rows += [(40, "six ten out a b c d e\ntale m"), (41, "six ten out a x c d e\ntale n")]  # one quarter is
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    gone = {*range(1, len(gaps)), 21, 22, 41}
    assert all(got[d] == (t.split("\n")[1] if d in gone else t) for d, t in rows)
