"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import math
import re
from collections import Counter

import pytest

from lakebrook.functions import text
from lakebrook.operators import index
from lakebrook.operators.snippets import snippets
from lakebrook.plans import entities
from lakebrook.plans.registry import ORACLES, QUERIES
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert check(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def rows(name, spark):
    return QUERIES[name](spark, SF).collect()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_stem_terms_equal_brute_force(spark):
    words = Counter(w for r in read(spark, "documents") for w in re.findall(r"\w+", (r.text or "").lower()))
    n, terms = Counter(), Counter()
    for word, times in words.items():
        stem = text.porter(word.translate(str.maketrans(*text.ACCENTS)))
        n[stem] += times
        terms[stem] += 1
    assert {r.stem: (r.n, r.terms) for r in rows("stem_terms", spark)} == {k: (n[k], terms[k]) for k in n}


def test_deoverlap_equals_brute_force(spark):
    turns = {}
    for r in sorted(read(spark, "conversations"), key=lambda r: (r.conv_id, r.turn, r.text)):
        turns.setdefault(r.conv_id, []).append(" ".join(r.text.split()))
    want = {}
    for conv, captions in turns.items():
        said = ""
        for c in captions:
            new = c[max(k for k in range(len(c) + 1) if said.endswith(c[:k])) :].strip()
            said = f"{said} {new}".strip()
        want[conv] = said
    assert {r.conv_id: r.text for r in rows("deoverlap", spark)} == want


def as_rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_stored_search_equals_scoring_every_chunk(spark):
    """Whole rows: ids, chunks, scores and ranks."""
    names = ("query_id", "evidence_id", "chunk_index", "score", "rank")
    want = as_rows(QUERIES["bm25_stemmed"](spark, SF), *names)
    assert as_rows(QUERIES["bm25_stored"](spark, SF), *names) == want
    # Porter stems counted by hand, in plain Python
    chunks = [(r.doc_id, i, line.strip(" ")) for r in read(spark, "documents") for i, line in enumerate(r.text.split("\n")) if line.strip(" ")]
    stem = lambda t: [text.porter(w.translate(str.maketrans(*text.ACCENTS))) for w in re.findall(r"[^\W]+", t.lower())]
    counted = [(d, i, Counter(stem(t))) for d, i, t in chunks]
    sizes = [sum(c.values()) for _, _, c in counted]
    average, df = sum(sizes) / len(sizes), Counter(w for _, _, c in counted for w in c)
    for question in read(spark, "benchmark")[:5]:
        asked = {text.porter(w.translate(str.maketrans(*text.ACCENTS))) for w in re.findall(r"[^\W]+", question.text.lower()) if w not in text.STOP_WORDS}
        best = {}
        for (d, i, c), n in zip(counted, sizes):
            gains = [max(math.log((len(sizes) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / average)) for w in asked & c.keys()]
            if gains and (d not in best or (-round(sum(gains), 6), i) < best[d]):
                best[d] = (-round(sum(gains), 6), i)
        top = sorted((s, d, i) for d, (s, i) in best.items())[:10]
        assert [(r[1], r[2]) for r in sorted((w for w in want if w[0] == question.item_id), key=lambda w: w[4])] == [(d, i) for _, d, i in top]


def test_excerpts_from_stored_places_equal_those_of_texts(spark):
    """Whole rows against excerpts cut from whole texts, and each against its item's text."""
    chunks, asked = entities.chunks(spark, SF), entities.questions(spark, SF)
    best = index.best_chunks(index.bm25(chunks, asked, stemmed=False), 4)
    top = index.top_items(best.where("rank = 1").drop("rank"), 10).select("query_id", "evidence_id")
    want = snippets(chunks, best.join(top, ["query_id", "evidence_id"], "left_semi"))
    found = QUERIES["snippet"](spark, SF)
    assert as_rows(found, "query_id", "evidence_id", "snippet") == as_rows(want, "query_id", "evidence_id", "snippet") != []
    texts = {r.doc_id: " ".join(" ".join(x.split()) for x in r.text.split("\n") if x.strip()) for r in read(spark, "documents")}
    for r in found.collect():
        # a longer one is cut anywhere, inside such a mark too; the rows above are compared whole
        parts = r.snippet.split(" […] ") if len(r.snippet) < 2390 else []
        assert len(r.snippet) <= 2400 and all(" ".join(p.split()) in texts[r.evidence_id] for p in parts)


def test_every_query_without_sql_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"stem_terms", "deoverlap", "snippet", "bm25_stemmed", "bm25_stored"}
