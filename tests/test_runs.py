"""Runs from sources to written tables, the stores they keep, and the embedder."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragweave.config import IngestConfig
from ragweave.operators import embedding, ingest
from ragweave.plans import runs
from ragweave.sources import catalog, stores


def raw_row(i, text):
    return (None, "", None, f"answer {i}", str(i), "DESCRIPTION", ([f"{text} one. And two.", "plain"], [f"{text} eins."], ["1", "0"]), f". what is {text}?", None, f"was ist {text}?")


@pytest.fixture
def shards(spark, tmp_path):
    (tmp_path / "raw" / "validation").mkdir(parents=True)
    for stem, texts in (("hin", ["red", "green", "blue"]), ("tam", ["red", "white"])):
        df = spark.createDataFrame([raw_row(i, t) for i, t in enumerate(texts)], catalog.RAW)
        pq.write_table(df.toArrow(), tmp_path / "raw" / "validation" / f"{stem}val.parquet")
    return {"validation": {"hi": str(tmp_path / "raw/validation/hinval.parquet"), "ta": str(tmp_path / "raw/validation/tamval.parquet"), "bn": str(tmp_path / "nowhere.parquet")}}


def test_ingest_and_index(spark, shards, tmp_path):
    out = str(tmp_path / "out")
    report = runs.ingest_run(spark, shards, ["hi", "ta", "bn", "xx"], out, IngestConfig(dedupe=True, examples_per_language=2))
    assert report["languages"] == ["hi", "ta"] and len(report["errors"]) == 2 and report["errors"][1].startswith("xx")
    assert report["records_emitted"] == 4 and report["language"] == {"hi": 2, "ta": 2} and report["query_type"] == {"DESCRIPTION": 4}
    passages = catalog.read_passages(spark, f"{out}/passages")
    assert passages.count() == report["passages_emitted"] and spark.read.json(f"{out}/examples").count() == 4
    assert report["passages_deduped"] > 0 and passages.groupBy("language", "text").count().where("count > 1").isEmpty()
    assert runs.load_passages(spark, f"{out}/passages", 3).count() == 3 and runs.load_passages(spark, f"{out}/passages", 9, ("hi",)).select("language").distinct().count() == 1
    assert runs.load_passages(spark, None, 2, ("en", "hi"), passages).count() == 2
    with pytest.raises(ValueError, match="neither"):
        runs.load_passages(spark, None, 2)
    first = runs.index_run(spark, passages, f"{out}/index", "structure")
    again = runs.index_run(spark, passages, f"{out}/index", "structure")
    assert first["points"] == again["points"] == first["chunks_indexed"] and first["cached_vectors"] == again["cached_vectors"] and first["passages_without_chunks"] == 0
    table = stores.VectorTable(spark, f"{out}/index/vectors")
    assert table.exists() and table.dimension() == 256 and "embedding" not in table.payloads().columns and len(stores.versions(spark, f"{out}/index/vectors")) == 2
    model = embedding.hashed_ngrams()
    asked = embedding.embedded(spark.createDataFrame([(7, "red one. And two.")], "query_id long, text string"), model).select("query_id", "embedding")
    hits = table.search(asked, 2, ["en"]).orderBy("rank").collect()
    assert len(hits) == 2 and hits[0]["score"] > 0.8 and table.payloads().where(F.col("point_id") == hits[0]["doc_id"]).head()["text"].startswith("red one")
    with pytest.raises(ValueError, match="recreate"):
        table.create(3)
    table.create(3, recreate=True)
    assert table.count() == 0 and table.dimension() == 3 and table.upsert(spark.createDataFrame([("p", "en", [1.0, 0.0, 0.0])], "point_id string, language string, embedding array<float>")) == 1
    with pytest.raises(Exception, match="another size"):
        table.upsert(spark.createDataFrame([("q", "en", [1.0])], "point_id string, language string, embedding array<float>"))
    table.delete()
    assert not table.exists()


def test_evaluation_run(spark, shards, tmp_path):
    raw = catalog.read_raw(spark, shards["validation"]["hi"], "hi", "validation")
    report = runs.evaluation_run(spark, ingest.examples(raw), str(tmp_path / "eval"))
    assert report["examples_seen"] == 3 and report["indic_emitted"] == report["english_emitted"] == 3 and report["queries"] == 6
    assert report["query_language"] == {"en": 3, "hi": 3} and sum(report["expected_route"].values()) == 6 and report["query_type"] == {"DESCRIPTION": 6}
    assert runs.evaluation_run(spark, ingest.examples(raw), str(tmp_path / "few"), cap=2)["queries"] == 2
    assert runs.load_queries(spark, str(tmp_path / "eval")).where("size(gold_document_ids) > 0 and query != ''").count() == 6
    (tmp_path / "bare.jsonl").write_text(json.dumps({"query_id": "1"}) + "\n")
    assert runs.load_queries(spark, str(tmp_path / "bare.jsonl")).head().asDict() == {"query_id": "1", "query": "", "query_language": "", "gold_document_ids": [], "query_type": "", "expected_route": ""}


def test_catalog_of_report_or_files(spark, shards, tmp_path):
    found = catalog.discover(spark, json.dumps({"shards": shards}), "unused")
    assert catalog.resolve(found, "ta", "validation") == shards["validation"]["ta"]
    (tmp_path / "files" / "train").mkdir(parents=True)
    (tmp_path / "files" / "train" / "bentrain.parquet").write_bytes(b"x")
    for report in (None, "{}"):
        assert [(r["split"], r["lang"]) for r in catalog.discover(spark, report, str(tmp_path / "files")).collect()] == [("train", "bn")]


def test_embedder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    model = embedding.Model("lengths", 2, load)
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "text string").coalesce(1)
    rows = embedding.embedded(df, model, "query").collect()
    assert [r["embedding"] is None for r in rows] == [False, False, False, True, False] and rows[0]["embedding"] == rows[2]["embedding"]
    assert rows[1]["embedding"] == pytest.approx([9 / 82**0.5, 1 / 82**0.5], abs=1e-6)  # "query: bb"
    loads = []
    once = embedding.Model("once", 2, lambda: loads.append(1) or len)
    assert embedding.loaded(once) is embedding.loaded(once) and loads == [1]
    cache = embedding.missing(df, spark.createDataFrame([], stores.CACHE), model)
    assert cache.count() == 3 and embedding.missing(df, cache, model).count() == 0
    assert embedding.missing(df, cache.withColumn("dimension", F.lit(5)), model).count() == 3
    got = embedding.from_cache(df, cache, model).collect()
    assert sum(r["embedding"] is not None for r in got) == 4 and len(got) == 5
    with pytest.raises(Exception, match="gives 2 numbers"):
        embedding.embedded(df, embedding.Model("wrong", 3, load)).collect()


def test_latencies(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0)], "retrieve double, rerank double")
    got = {r["stage"]: r for r in runs.latencies(df, ["retrieve", "rerank"]).collect()}
    assert (got["retrieve"]["mean"], got["retrieve"]["p50"], got["retrieve"]["p100"]) == (2.0, 2.0, 3.0)
    assert got["rerank"]["n"] == 2 and got["total"]["p100"] == 33.0 and got["total"]["p50"] == 11.0
    assert set(runs.warm_up(spark, {"a": df})) == {"a"}


def test_command_line(spark, shards, tmp_path, capsys):
    from ragweave.__main__ import main

    out = str(tmp_path / "out")
    report = main(["ingest", str(tmp_path / "raw"), "--out", out, "--dedupe"], spark)
    assert report["languages"] == ["hi", "ta"] and json.loads(capsys.readouterr().out) == json.loads(json.dumps(report))
    assert main(["inspect", str(tmp_path / "raw")], spark)["examples"] == 5
    assert main(["index", f"{out}/passages", "--out", f"{out}/index", "--strategy", "sliding"], spark)["points"] > 0
    runs.evaluation_run(spark, ingest.examples(catalog.read_raw(spark, shards["validation"]["hi"], "hi", "validation")), f"{out}/eval")
    hits = main(["search", f"{out}/eval", "--index", f"{out}/index", "--out", f"{out}/hits", "--k", "2"], spark)
    assert hits["dense"] > 0 and sum(main(["route", f"{out}/eval"], spark).values()) == 6
