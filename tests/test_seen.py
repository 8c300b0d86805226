"""Keep-first over batches against one run over all of them."""

import re

import pytest
from pyspark.sql import functions as F

from ragweave.sources.seen import SeenKeys

ROWS = [(i, [None, "", "x", "y", f"t{i % 37}", "hot"][i % 6] if i % 11 else f"only {i}", i % 4) for i in range(400)]


@pytest.fixture
def batches(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, bucket int")  # a column named as one of the key table
    return [df.where(f"bucket = {k}") for k in range(4)]


def whole(rows):
    """Ids that one run keeps, rows in the order of batch and id, and how many repeats each batch has of a kept key."""
    first, repeats = {}, {}
    for i, t, k in sorted(rows, key=lambda r: (r[2], r[0])):
        if t in first:
            repeats[first[t]] += first[t] % 4 == k
        else:
            first[t], repeats[i] = i, 0
    return repeats


def run(seen, batches, k):
    return {r["id"]: r["repeats"] for r in seen.first(batches[k], [F.col("text")], ["id"], k).collect()}


def test_batches_keep_what_one_run_keeps(spark, batches, tmp_path):
    seen, got = SeenKeys(spark, str(tmp_path / "s"), 8), {}
    for k in range(4):
        part = run(seen, batches, k)
        assert not set(part) & set(got)
        got |= part
    assert got == whole(ROWS) and seen.batches() == [0, 1, 2, 3]


def test_a_batch_that_runs_again_gives_the_same(spark, batches, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"), 8)
    one = [run(seen, batches, k) for k in range(3)]
    assert run(seen, batches, 1) == one[1] and run(seen, batches, 2) == one[2]
    assert sum(len(x) for x in one) == seen.before(3).count()


def test_an_unfinished_batch_is_not_met(spark, batches, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"), 8)
    want = run(seen, batches, 0)
    (tmp_path / "s" / "batch=0" / "_SUCCESS").unlink()
    assert seen.batches() == [] and run(seen, batches, 1).keys() & {r[0] for r in ROWS if r[2] == 1}
    assert run(seen, batches, 0) == want


def test_small_batches_read_their_buckets_only(spark, batches, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"), 16)
    run(seen, batches, 0)
    few = spark.createDataFrame([(9000, "x", 1)], "id long, text string, bucket int")
    old = seen.before(1)
    key = few.select(F.pmod(F.xxhash64("text", F.col("text").isNull()), F.lit(16)).alias("k")).head()["k"]
    plan = old.where(F.col("bucket").isin([key]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert seen.first(few, [F.col("text")], ["id"], 1).count() == 0


def test_empty_batch(spark, batches, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"), 8)
    assert seen.first(batches[0].limit(0), [F.col("text")], ["id"], 0).collect() == []
    assert seen.batches() == [0] and run(seen, batches, 1).keys() == set(whole([r for r in ROWS if r[2] == 1]))
