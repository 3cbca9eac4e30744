"""The caption fold against brute force, one item with very many captions, and the inventory of files."""

import random

import pytest
from pyspark.sql import functions as F

from lakebrook.functions.text import rolled
from lakebrook.operators import captions
from lakebrook.sources import inventory


def brute(texts):
    said = ""
    for c in (" ".join((t or "").split()) for t in texts):
        new = c[max(k for k in range(len(c) + 1) if said.endswith(c[:k])) :].strip()
        said = f"{said} {new}".strip()
    return said


def test_captions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for item in range(40):
        words = [rng.choice("ab cd ef").strip() or "x" for _ in range(40)]
        for i in range(rng.randint(0, 25)):
            text = rng.choice([" ".join(words[i : i + rng.randint(1, 8)]), None, "", " \n", words[i] * 50])
            rows.append((item or None, i, text, "extra"))
    df = spark.createDataFrame(rows, "k long, n long, t string, most string").repartition(7)
    want = {k: brute([t for x, _, t, _ in rows if x == k]) for k in {r[0] for r in rows}}
    assert {r.k: r.text for r in captions.prose(df, "k", ["n"], "t").collect()} == want
    fresh = captions.deoverlapped(df, "k", ["n"], "t").orderBy("k", "n").collect()
    assert len(fresh) == len(rows) and {k: " ".join(r.fresh for r in fresh if r.k == k and r.fresh) for k in want} == want
    assert captions.prose(df.limit(0), "k", ["n"], "t").count() == 0


def test_an_item_of_very_many_captions_is_no_list(spark):
    """Each caption repeats most of the one before; the plan gathers nothing."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("n"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("w"), F.col("id") + 1)).alias("t"))
    found = captions.deoverlapped(df, "k", ["n"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroups" not in plan
    got = found.agg(F.count("*").alias("n"), F.count_if(F.when(F.col("n") == 0, F.col("fresh") == "w0 w1").otherwise(F.col("fresh") == F.concat(F.lit("w"), F.col("n") + 1))).alias("right")).first()
    assert tuple(got) == (n, n) and rolled(["w0 w1", "w1 w2", "w2 w3"]) == "w0 w1 w2 w3"


@pytest.mark.parametrize("excluded", [(), ("skip", "b")])
def test_files_are_counted_by_suffix_and_not_opened(spark, tmp_path, excluded):
    made = {"x.JSON": 3, "a/y.json": 5, "a/skip/z.json": 7, "a/b c+%/w.tar.gz": 11, "b/noext": 2, "b/.hidden": 1, "skipped/v.md": 4}
    for name, size in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = inventory.inventory(spark, str(tmp_path), excluded)
    seen = {f"{r.folder}/{r.name}".strip("/"): (r.suffix, r.length) for r in files.collect()}
    kept = {n: s for n, s in made.items() if not set(n.split("/")[:-1]) & set(excluded) and not n.rsplit("/")[-1].startswith(".")}
    assert {n: s for n, (_, s) in seen.items()} == kept
    assert {n: x for n, (x, _) in seen.items()} == {n: {"json": ".json", "gz": ".gz", "md": ".md"}.get(n.rsplit(".")[-1].lower(), "") for n in kept}
    counts = {r.suffix: (r.files, r.bytes) for r in inventory.by_suffix(files).collect()}
    assert counts[".json"] == ((3, 15) if not excluded else (2, 8))
    scan = inventory.by_suffix(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in scan and "content" not in scan.split("ReadSchema")[1].split("\n")[0]
