"""scope_violations against its SQL on letters beyond ASCII, which end a word in the SQL's engine."""

import duckdb

import __spark_entry__


def test_scope_violations_equals_its_sql_on_letters_beyond_ascii(spark, tmp_path):
    far = "no rarrta. Ciónue que de ososas ciezado. Asraes de."
    texts = [
        far, "no " + "é" * 9, "nó no ñ ñ", "éno", "noé", "never ſo ſK ſ", "ındustry consensus", "İndustry consensus", "all source\u017f agree", "Every source agrees", "experts broadly agree\u212a", "Industry conſenſus", "éindustry consensus", "the corpus proveſ", "the corpus provesé", "not́ a b",
        "no a b c d e f g h", "no a b c d e f g h i", "no\n", "all ſources agree", "\u0001 no", "no " + "x" * 80, "", None, "every source agreesé. Experts widely agree",
    ]
    rows = [(4 * i + j, t) for i, t in enumerate(texts) for j in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {tuple(r) for r in __spark_entry__.queries()["scope_violations"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(__spark_entry__.oracle_sql()["scope_violations"]).fetchall()) and len(got) == len(rows)
