"""Large shards are read in parts, shards of several files whole; a row limit holds for the shard."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragweave.plans import queries
from ragweave.sources import catalog, shard_source


@pytest.fixture
def files(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([("e", "", None, "a" * 500, str(i), "q", None, None, None, "w") for i in range(a, b)], catalog.RAW).toArrow()
    out = []
    for name, (a, b) in {"a": (0, 40), "b": (40, 45), "c": (45, 45), "d": (45, 50)}.items():
        out.append(str(tmp_path / f"{name}.parquet"))
        pq.write_table(rows(a, b), out[-1], row_group_size=10)
    return out


def read(shards, rows=0):
    """Partitions, query ids and errors, as the planner and the tasks give them."""
    reader = shard_source.ShardReader([shard_source.Shard([p] if isinstance(p, str) else p, "train", lang) for lang, p in shards.items()], rows)
    parts = reader.partitions()
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    return len(parts), sorted(int(r["query_id"]) for r in got if r["error"] is None), sum(r["error"] is not None for r in got)


def test_parts(spark, files, tmp_path, monkeypatch):
    assert read({"hi": files})[0] == 1  # small files go together
    assert shard_source.read(spark, {"train": {"hi": files}}, 42).where("error is null").count() == 42
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"no" * 5000)
    for size in (1, 3000, 1 << 30):
        monkeypatch.setattr(shard_source, "PART_BYTES", size)
        assert read({"hi": files})[1:] == (list(range(50)), 0)
        for n in (1, 10, 15, 40, 42, 47, 50, 99):
            assert read({"hi": files}, n)[1:] == (list(range(min(n, 50))), 0)
            assert read({"hi": files[0]}, n)[1:] == (list(range(min(n, 40))), 0)
        assert read({"hi": [files[1], str(broken), "/nowhere.parquet", files[3]], "ta": files[0]})[1:] == (list(range(50)), 2)
    monkeypatch.setattr(shard_source, "PART_BYTES", 1)
    assert read({"hi": files[0]})[0] == 4  # one partition a shard before


def test_catalog_keeps_all_files(spark, files):
    df = spark.createDataFrame([(p, "train", "hi") for p in reversed(files)] + [("x", "train", "ta")], "path string, split string, lang string")
    assert shard_source.catalog_of(df) == {"train": {"hi": files, "ta": "x"}}


def test_a_shard_is_not_written_by_one_task(spark, tmp_path):
    """Documents of one language come from several tasks and go to several files, all of which are read."""
    spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.ingest_shards(spark, str(tmp_path))
    got = df.collect()
    assert sorted(r["query_id"] for r in got if r["error"] is None) == [i for i in range(40) if i % 3] and sum(r["error"] == "unreadable" for r in got) == 1
