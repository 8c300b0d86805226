"""The growing lexical index against a fresh build, and what its bounds save."""

import random

import pytest

from ragweave.operators import ranking
from ragweave.sources import lexical
from ragweave.sources.lexical import LexicalStore

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, ids):
    return {i: " ".join(rng.choices(WORDS, weights=[1 / (1 + j) for j in range(60)], k=rng.choice([3, 8, 40]))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "w0 w1 w1"), (2, "w50 w3"), (3, "w59 w58 w57 nothing"), (4, "nothing"), (5, None)], "query_id long, text string")


def test_batches_equal_a_fresh_build(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "FIRST", 1)
    monkeypatch.setattr(lexical, "PRUNED_FROM", 100)  # the first steps score all blocks, the others don't
    rng, store = random.Random(3), LexicalStore(spark, str(tmp_path / "index"))
    assert store.search(asked).collect() == [] and store.segments() == []
    docs = {}

    def same():
        want = rows(ranking.LexicalIndex.build(frame(spark, docs)).search(asked, 7))
        assert rows(store.search(asked, 7)) == want and want
        assert store.totals()["n"] == sum(bool(t.strip()) for t in docs.values())

    for batch in (texts(rng, range(90)), texts(rng, range(80, 130)), {5: "w0", 6: "", 7: "w50 w50", 200: "w59"}):
        docs |= batch
        store.add(frame(spark, batch))
    same()
    store.delete(frame(spark, {i: "" for i in range(20, 60)} | {999: ""}))
    docs = {i: t for i, t in docs.items() if not 20 <= i < 60}
    docs = {i: t for i, t in docs.items() if i % 9} | texts(rng, range(100, 110)) | {300: "w1 w1 w2"}
    before = len(store.segments())
    store.sync(frame(spark, docs))
    same()
    assert len(store.segments()) == before + 2
    store.sync(frame(spark, docs))  # nothing has changed
    assert len(store.segments()) == before + 2
    even = frame(spark, docs).where("doc_id % 2 = 0")
    assert rows(store.search(asked, 7, even)) == rows(ranking.LexicalIndex.build(frame(spark, docs)).search(asked, 7, even))
    store.compact()
    assert len(store.segments()) == 1
    store.add(frame(spark, {301: "w1 w3 w3"}))
    docs |= {301: "w1 w3 w3"}
    same()


def test_a_batch_does_not_read_earlier_texts(spark, tmp_path, asked):
    rng, store = random.Random(4), LexicalStore(spark, str(tmp_path / "index"))
    store.add(frame(spark, texts(rng, range(50))))
    n = store.segments()[-1]
    store.add(frame(spark, texts(rng, range(100, 120))))
    at = f"{store.path}/v={store.segments()[-1]}"
    assert spark.read.parquet(f"{at}/documents").count() == 20 and n in store.segments()
    assert spark.read.parquet(f"{at}/terms").where("df <= 0").isEmpty()


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Few postings of frequent terms are read where a rare term decides."""
    monkeypatch.setattr(lexical, "PRUNED_FROM", 0)
    rng = random.Random(5)
    docs = texts(rng, range(4000)) | {i: "w0 w1 rare" for i in range(5000, 5012)}
    store = LexicalStore(spark, str(tmp_path / "index"))
    store.add(frame(spark, docs))
    q = spark.createDataFrame([(1, "w0 w1 rare"), (2, "w40 w2")], "query_id long, text string")
    assert rows(store.search(q, 5)) == rows(ranking.LexicalIndex.build(frame(spark, docs)).search(q, 5))
    got = {r["query_id"]: r for r in store.postings_read(q, 5).collect()}
    assert got[1]["read"] < 0.5 * got[1]["asked"] and all(r["read"] <= r["asked"] for r in got.values())
