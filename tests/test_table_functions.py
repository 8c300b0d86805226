"""The chunkers in SQL give the rows of the plans; rerankers are chosen; models are warmed up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig
from ragweave.operators import chunking, embedding, ranking, table_functions
from ragweave.plans import runs

SF = "/root/testdata/sf0.001"
SQL = "SELECT p.document_id, c.* FROM {p} p, LATERAL chunk(p.text, '%s') c"


def odd_texts():
    """Sentences of many lengths and scripts, with odd separators; null, blank and very long texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeéñकखாب", k=r.randint(1, 9)))
    out = [None, "", " \x1c ", "no end", "One.\x1cTwo.", "a." + "　" * 3 + "b! c? d۔ e… f", ". . .", "x" * 3000, "One. " * 2000]
    for _ in range(150):
        topic = [word() for _ in range(4)]
        text = ""
        for _ in range(r.randint(1, 14)):
            topic = topic if r.random() < 0.6 else [word() for _ in range(4)]
            text += " ".join(r.choices(topic, k=r.randint(1, 40))) + r.choice([". ", "! ", "।\n", "؟ \t", "…\xa0", ".", ", "])
        out.append(text)
    return out


@pytest.mark.parametrize("cfg", [ChunkConfig(), ChunkConfig(overlap=0, window=3, window_overlap=0, min_sentences=2, min_chars=20, max_chars=300, target_chars=150, similarity=0.6, max_sentences=2, target_sentences=4)])
@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_rows_are_those_of_the_plan(spark, strategy, cfg):
    given = spark.createDataFrame([(i, t, "en") for i, t in enumerate(odd_texts())], "query_id long, text string, language string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("query_id"), "text", F.col("lang").alias("language"))
    p = chunking.passages(given.union(docs))
    table_functions.register(spark, "chunk", cfg)
    names = ["document_id", "chunk_index", "start_sentence", "end_sentence", "text", "char_length", "sentence_count", "adaptive_reason"]
    got = spark.sql(SQL % strategy, p=p).select(*names)
    want = chunking.chunks(p, strategy, cfg).select(*names)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_rows_for_nothing_and_unknown_strategies_fail(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "One. Two.")], "id int, text string")
    assert [tuple(r) for r in spark.sql("SELECT id, c.text FROM {d} d, LATERAL chunk(d.text, 'structure') c", d=df).collect()] == [(3, "One. Two.")]
    assert spark.sql("SELECT id, c.text FROM {d} d, LATERAL chunk(d.text, 'sliding') c", d=df.where("id > 3")).count() == 0
    with pytest.raises(Exception, match="strategy is one of"):
        spark.sql("SELECT c.text FROM {d} d, LATERAL chunk(d.text, 'by ear') c", d=df).collect()


def test_first_of_each_breaks_ties_by_text(spark):
    rows = [("k", "d", "b"), ("k", "d", "a"), ("k", "e", "0"), ("l", "d", "z")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "chunk_id string, document_id string, text string").repartition(3)
        assert sorted(map(tuple, chunking.first_of_each(df).collect())) == [("k", "d", "a"), ("l", "d", "z")]


def test_rerankers_are_chosen(spark):
    @F.pandas_udf("double")
    def score(query, text):
        return text.str.len().astype(float)

    def broken():
        raise OSError("no such model")

    hits = spark.createDataFrame([(1, "a b", "a", 0.5, 1, 2), (1, "a b", "a b c", 0.4, 2, 2), (1, "a b", "a longer text", 0.3, 3, 2)], "query_id int, query string, text string, rrf double, rank int, n int")
    texts = lambda chosen: [r["text"] for r in chosen[1](hits, F.col("n")).orderBy("rank").collect()]
    name, run = ranking.reranker("auto", lambda: score)
    assert name == "model" and [r["text"] for r in run(hits, F.col("n")).orderBy("rank").collect()] == ["a b c", "a"]
    assert [r["text"] for r in run(hits, 3).orderBy("rank").collect()] == ["a longer text", "a b c", "a"]
    for kind, load in (("auto", broken), ("auto", None), ("lexical", lambda: score)):
        assert ranking.reranker(kind, load)[0] == "lexical" and texts(ranking.reranker(kind, load)) == ["a b c", "a"]
    with pytest.raises(OSError, match="no such model"):
        ranking.reranker("model", broken)
    for kind in ("model", "by ear"):
        with pytest.raises(ValueError):
            ranking.reranker(kind)


def test_warm_up_loads_models_once_a_worker(spark, tmp_path):
    where = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{where}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.ones((len(texts), 3))

    model = embedding.Model("counted", 3, load)
    df = spark.range(3).select(F.lit("t").alias("text"))
    probe = embedding.embedded(df, model)
    got = runs.warm_up(spark, {"table": df}, (model,), probe)
    assert list(got) == ["table", "counted", "warm_request"] and all(v >= 0 for v in got.values())
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))
