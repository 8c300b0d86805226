"""The shard source, ingest runs over repeated ids and broken shards, and their reports."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragweave.config import IngestConfig
from ragweave.operators import evaluation, ingest
from ragweave.plans import runs
from ragweave.sources import catalog, shard_source


def raw_row(i, en, tr="", query="wer?", answer="a"):
    return ("eng_Latn", "", None, answer, str(i), "DESCRIPTION", (en, [tr] * len(en), ["1"] * len(en)), f"who is {en[0]}?", None, query)


@pytest.fixture
def shards(spark, tmp_path):
    rows = {("validation", "hi"): [raw_row(1, ["red one"]), raw_row(1, ["green two", "red one"]), raw_row("none", ["x"])], ("validation", "ta"): [raw_row(1, ["blue"])] * 3, ("train", "hi"): [raw_row(1, ["gold"])]}
    out: dict = {"validation": {"bn": str(tmp_path / "nowhere.parquet"), "gu": str(tmp_path / "broken.parquet")}}
    (tmp_path / "broken.parquet").write_bytes(b"not parquet")
    for (split, lang), found in rows.items():
        path = str(tmp_path / f"{split}-{lang}.parquet")
        table = spark.createDataFrame(found, catalog.RAW).toArrow()
        pq.write_table(table.drop_columns(["meta"]) if lang == "ta" else table, path)
        out.setdefault(split, {})[lang] = path
    return out


def test_source(spark, shards):
    df = shard_source.read(spark, shards)
    assert df.rdd.getNumPartitions() == 5 and df.where("error is null").count() == 7
    bad = {r["shard_lang"]: r["error"] for r in df.where("error is not null").collect()}
    assert set(bad) == {"bn", "gu"} and all(bad.values())
    assert df.where("error is null and split = 'train'").select("query_id", "passages.English_passages").collect() == [("1", ["gold"])]
    assert df.where("shard_lang = 'ta'").where("meta is null").count() == 3  # a field that the file lacks
    assert shard_source.read(spark, shards, 2).where("error is null").groupBy("split", "shard_lang").count().agg(F.max("count")).head()[0] == 2
    assert shard_source.read(spark, {}).count() == 0


def test_ruled_out_shards_are_not_opened(spark, shards):
    df = shard_source.read(spark, shards)
    assert df.where("split = 'validation' and shard_lang in ('hi', 'ta')").rdd.getNumPartitions() == 2
    assert df.where("split = 'nothing'").count() == 0
    plan = df.where("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "= train" not in plan  # the source has applied it
    kept = df.where("split = 'validation' and query_id = '1' and error is null")
    assert kept.count() == 5


def test_examples_that_share_an_id_keep_their_own_passages(spark, shards):
    raw = shard_source.read(spark, shards).where("error is null and shard_lang = 'hi'")
    full = ingest.examples(raw)
    got = {tuple(p["text"] for p in r["passages"]): r for r in ingest.deduped(full).collect()}
    assert set(got) == {("gold",), ("red one",), ("green two",)} or set(got) == {("gold",), (), ("green two", "red one")}
    assert all(len(r["gold_document_ids"]) == len(r["passages"]) for r in got.values())
    assert ingest.deduped(full).columns == full.columns
    r = ingest.report(raw, IngestConfig(dedupe=True)).head()
    assert (r["records_emitted"], r["passages_emitted"], r["passages_deduped"]) == (3, 3, 1)


def test_equal_rows_are_examples_of_their_own(spark, shards):
    rows = ingest.deduped(ingest.examples(shard_source.read(spark, shards).where("error is null and shard_lang = 'ta'"))).collect()
    assert sorted(len(r["passages"]) for r in rows) == [0, 0, 1]


def test_gold_by_example(spark, shards):
    ex = ingest.examples(shard_source.read(spark, shards).where("error is null and split = 'validation' and shard_lang = 'hi'"))
    indexed = spark.createDataFrame([("1:1:en",), ("1:1:en",)], "doc_id string")
    rows = evaluation.gold_set(ex, indexed, include_english=False).collect()
    assert [r["gold_document_ids"] for r in rows] == [["1:1:en"]]  # the second example's; the first has none left
    r = evaluation.gold_report(ex, indexed, include_english=False).head()
    assert (r["examples_seen"], r["examples_without_gold"], r["dropped_no_indexed_gold"], r["indic_emitted"]) == (2, 0, 1, 1)


def test_run_reads_its_source_once(spark, shards, tmp_path, monkeypatch):
    opened = tmp_path / "opened"
    opened.mkdir()
    read = shard_source.read

    def counted(spark, shards, rows=None):
        mark = F.udf(lambda x: open(f"{opened}/{__import__('uuid').uuid4().hex}", "w").close() or x)
        return read(spark, shards, rows).withColumn("query_type", mark("query_type"))

    monkeypatch.setattr(runs.shard_source, "read", counted)
    out = str(tmp_path / "out")
    report = runs.ingest_run(spark, shards, ["ta", "hi", "bn", "gu", "xx"], out, IngestConfig(dedupe=True))
    assert len(list(opened.iterdir())) <= 6 + 2  # a row once, error rows at most beside them
    assert report["languages"] == ["ta", "hi"] and [e[:2] for e in report["errors"]] == ["bn", "gu", "xx"]
    assert (report["records_processed"], report["unusable_ids"], report["records_emitted"]) == (6, 1, 5)
    assert (report["passages_emitted"], report["passages_deduped"]) == (3, 3)
    assert json.loads(spark.read.text(f"{out}/report").head()[0]) == report
    part = next(f for f in (tmp_path / "out" / "passages").iterdir() if f.suffix == ".json" and f.stat().st_size)
    assert runs.load_passages(spark, str(part), 1).count() == 1  # a single file


def test_run_without_any_shard(spark, tmp_path):
    report = runs.ingest_run(spark, {}, ["hi"], str(tmp_path / "out"))
    assert report["languages"] == [] and report["records_processed"] == 0 and report["errors"] == ["hi: no validation shard; there are none"]
