"""Small functions by value."""

from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.functions.session import release_settled, settled
from ragweave.operators import chunking, evaluation
from ragweave.sources import catalog


def test_language_codes(spark):
    given = ["hin_Deva", "ORY_Orya", "eng_Latn", "hin", "xxx_Latn", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(X.short_language(F.col("c"))).collect()]
    assert got == ["hi", "or", "en", None, None, None, None]


def test_model_slug(spark):
    df = spark.createDataFrame([("org/model v1.5",), ("é-ok_2",), (None,)], "c string")
    assert [r[0] for r in df.select(X.model_slug(F.col("c"))).collect()] == ["org_model_v1.5", "é-ok_2", None]


def test_script_language_of_other_scripts(spark):
    rows = [("हिन्दी", "hi"), ("தமிழ்", "ta"), ("اردو", "ur"), ("plain", "en"), ("123", "und"), ("", "und")]
    df = spark.createDataFrame(rows, "c string, want string")
    got = {r["c"]: r["got"] for r in df.select("c", X.script_language(F.col("c")).alias("got")).collect()}
    assert got["plain"] == "en" and got["123"] == got[""] == "und" and got["தமிழ்"] == "ta" and got["हिन्दी"] == "hi"


def test_document_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "document_id string, x int")
    assert sorted(r[0] for r in catalog.document_ids(df).collect()) == ["a", "b"]


def test_write_report(spark, tmp_path):
    catalog.write_report(spark.createDataFrame([(1, None, [2])], "a int, b string, c array<int>"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"a":1,"c":[2]}']


def test_reason_histogram(spark):
    rows = [(1, "Short one.", "en"), (2, "A sentence here. " * 12, "en"), (3, "Tiny.", "en")]
    c = chunking.chunks(chunking.passages(spark.createDataFrame(rows, "query_id long, text string, language string")), "adaptive")
    got = {r["adaptive_reason"]: r["chunks"] for r in evaluation.reasons(c).collect()}
    assert got["structure:short_passage"] == 2 and got["sliding:long_passage"] >= 3


def test_settled_tables_are_deleted(spark):
    df = settled(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert df.count() == 3 and os.path.isdir(path)
    release_settled(spark)
    assert not os.path.exists(path)
