"""The cell index against the exact scan, and the scan over odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragweave.operators import ranking
from ragweave.sources import vectors
from ragweave.sources.vectors import VectorIndex

KIND = "doc_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[rng.integers(40)] + 0.35 * rng.normal(size=16)], int(i % 3)) for i in range(6000)]
    rows += [(6000 + i, rows[5][1], 1) for i in range(1500)]  # a hot cell: copies
    return spark.createDataFrame(rows, KIND).repartition(6).cache()


def pairs(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


def asked(many):
    return many.where("doc_id % 50 = 7 and doc_id < 6000").select(F.col("doc_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dot"])
def test_recall_against_the_exact_scan(spark, many, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(vectors, "PART", 400)
    index = VectorIndex(spark, str(tmp_path / "index"), metric)
    index.build(many, sample=2000)
    assert index.rows().count() == many.count()  # every row is indexed, whatever the sample
    exact = ranking.dense_search(many, asked(many), 10, metric)
    assert pairs(index.search(asked(many), 10, probes=10_000)) == pairs(index.search(asked(many), 10, probes=None)) == pairs(exact)
    if metric != "dot":  # the nearest cells need not hold the greatest products
        found = pairs(index.search(asked(many), 10, probes=12, block=30))
        assert len(found & pairs(exact)) >= 0.9 * len(pairs(exact))
    only = index.search(asked(many), 5, probes=10_000, where=F.col("label") == 2)
    assert pairs(only) == pairs(ranking.dense_search(many, asked(many), 5, metric, F.col("label") == 2))


def test_only_probed_cells_are_read(spark, many, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(many)
    one = asked(many).limit(1)
    plan = index.search(one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"PartitionFilters: \[cell#\d+ IN \(([\d,]+)\)", plan).group(1).split(",")) == 2
    assert index.rows().select("cell").distinct().count() > 20


def test_null_and_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, None], 1), (4, [1.0], 1), (5, [0.6, 0.8], 1), (6, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, KIND)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [1.0])], "query_id long, embedding array<float>")
    want = {(1, 1), (1, 5), (1, 6), (4, 4)}
    assert pairs(ranking.dense_search(df, q, 5)) == want
    assert pairs(ranking.dense_search(df.limit(0), q, 5)) == pairs(ranking.dense_search(df, q.limit(0), 5)) == set()
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(df)
    assert pairs(index.search(q, 5)) == want - {(4, 4)}
    index.build(df.limit(0))
    assert pairs(index.search(q, 5)) == set()


def test_blocks_give_the_same_rows(spark, many):
    few = many.where("doc_id < 900")
    assert pairs(ranking.dense_search(few, asked(few), 4, block=70)) == pairs(ranking.dense_search(few, asked(few), 4))


def test_pages_of_payloads(spark, tmp_path):
    from ragweave.sources.stores import VectorTable

    t = VectorTable(spark, str(tmp_path / "points"))
    assert list(VectorTable(spark, str(tmp_path / "none")).pages()) == []
    t.create(2)
    assert list(t.pages()) == []
    points = spark.createDataFrame([(f"p{i:03d}", ["hi", "ta"][i % 2], f"text {i}", [1.0, float(i)]) for i in range(50)], "point_id string, language string, text string, embedding array<float>")
    t.upsert(points.repartition(5))
    pages = list(t.pages(size=20))
    assert [len(p) for p in pages] == [20, 20, 10] and [r["point_id"] for p in pages for r in p] == [f"p{i:03d}" for i in range(50)]
    assert "embedding" not in pages[0][0].asDict() and pages[1][0]["text"] == "text 20"
    rest = [r["point_id"] for p in t.pages(after=pages[0][-1]["point_id"], size=7) for r in p]
    assert rest == [f"p{i:03d}" for i in range(20, 50)]
    assert [r["point_id"] for p in t.pages(size=10, languages=["ta"]) for r in p] == [f"p{i:03d}" for i in range(1, 50, 2)]
    assert [len(p) for p in t.pages(size=25)] == [25, 25]
    plan = t.page(after="p010")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "PushedFilters: [IsNotNull(point_id), GreaterThan(point_id,p010)]" in plan and "TakeOrderedAndProject" in plan
