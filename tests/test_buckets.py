"""Searches of many questions go by bucket of documents."""

import random

from ragweave.operators import ranking
from ragweave.sources import lexical
from ragweave.sources.lexical import LexicalStore


def test_buckets(spark, tmp_path, monkeypatch):
    """Many questions over replaced and deleted documents, some allowed: no row for a posting and a question."""
    for name, value in (("BUCKET", 16), ("CELLS", 64), ("PRUNED_FROM", 0), ("BROADCAST_QUERIES", 1)):
        monkeypatch.setattr(lexical, name, value)
    rng, words = random.Random(9), [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rng.choices(words, k=rng.choice([1, 5, 30]))) for i in range(120)} | {i: "w1 w2" for i in range(200, 230)}
    store, frame = LexicalStore(spark, str(tmp_path / "index")), lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    store.add(frame(docs))
    new = {i: "w3 w3 w4" for i in range(0, 40, 5)} | {400: "w29"}
    store.add(frame(new))
    store.delete(frame({i: "" for i in range(50, 60)}))
    docs = {i: t for i, t in (docs | new).items() if not 50 <= i < 60}
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=1 + i % 9))) for i in range(40)] + [(None, "w5 w6"), ("none", "nothing")], "query_id string, text string")
    rows = lambda df: sorted((str(r["query_id"]), r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    for allowed in (None, frame(docs).where("doc_id % 3 = 0")):
        got = store.search(asked, 7, allowed)
        assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(ranking.LexicalIndex.build(frame(docs)).search(asked, 7, allowed))
