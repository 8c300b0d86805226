"""Texts are cut whole and counted in their rows: the tokens are those cut one by one, and nothing is shuffled to count them."""

from collections import Counter

from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.sources import lexical
from ragweave.sources.lexical import LexicalStore


def test_tokens_of_every_character(spark):
    """Cutting a folded text between its tokens gives the folded tokens, for all code points and beside others."""
    points = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for before, after in (("aB", "Cd"), ("1.", "."), ("", "")):
        text = F.concat(F.lit(before), F.col("c"), F.lit(after))
        for marks, token in ((False, X.TOKEN), (True, X.TOKEN_WITH_MARKS)):
            each = F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), X.folded)
            assert points.where(X.tokens(text, marks) != each).count() == 0
    odd = spark.createDataFrame([(t,) for t in ("ΟΔΟΣ ΟΔΟΣ' ΣΑΣ", "Straße STRASSE ẞ", "İstanbul ISTANBUL", " ,a,, b. ", "...", "", None, "निगम क्या है?")], "t string")
    each = F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(X.TOKEN), F.lit(1)), X.folded)
    assert odd.where(X.tokens(F.col("t")) != each).count() == 0


def test_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", 7)
    texts = {1: "b a b", 2: "...", 3: "a " * 50 + "c", 4: "Z", 5: "a b c d e f g h i a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = LexicalStore._cut(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()  # postings were dealt out by block before
    got = {r["doc_id"]: {t["term"]: t["tf"] for t in r["terms"]} for r in rows.collect()}
    assert got == {i: dict(Counter(t.lower().replace(".", "").split())) for i, t in texts.items()}
    df = {r["term"]: r["df"] for r in lexical.frequencies(rows).groupBy("term").agg(F.sum("df").alias("df")).collect()}
    assert df == dict(Counter(t for terms in got.values() for t in terms))
    store = LexicalStore(spark, str(tmp_path / "index"))
    store.add(docs)
    assert spark.read.parquet(f"{store.path}/v=1/documents").where("size(terms) = 0").select("doc_id", "length").collect() == [(2, 0)]
