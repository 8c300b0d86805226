"""Composition runs in the JVM and is that of Python's library."""

import unicodedata

from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.operators import evaluation, ingest
from ragweave.plans import queries


def test_as_unicodedata(spark):
    marks = "़̣̀́̇াୗාᅡᆨ゙"
    # Characters that both libraries know; Python's may be a version of Unicode behind.
    codes = [chr(k) for k in range(0x20, 0x1F000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    texts = [x for k in range(0, len(codes), 40) for x in ("".join(codes[k : k + 40]), "".join(c + m for c in codes[k : k + 40] for m in marks))]
    rows = [(t, [t, None, "plain", "é"]) for t in texts] + [(None, None), ("", []), ("plain", [None])]
    df = spark.createDataFrame(rows, "t string, a array<string>").repartition(4)
    one = lambda x: x if x is None else unicodedata.normalize("NFC", x)
    for r in df.select("t", "a", X.nfc(F.col("t")).alias("n"), X.nfc_each(F.col("a")).alias("m")).collect():
        assert r["n"] == one(r["t"]) and r["m"] == (None if r["a"] is None else [one(x) for x in r["a"]])


def test_no_python_workers(spark):
    raw = queries.raw_examples(spark, "/root/testdata/sf0.001")
    full = ingest.examples(raw)
    for df in (full, ingest.deduped(full), ingest.report(raw), evaluation.gold_report(full)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
