"""Keep-first across runs: a table of the keys that earlier batches had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragweave.functions.session import settled
from ragweave.sources import stores

KEYS = "a long, b long, batch int, bucket int"


class SeenKeys:
    """The keys of all batches so far, 16 bytes each, in folders by batch and hash bucket.

    A batch meets only the buckets that its own keys fall into, and no earlier row is read again. A batch
    whose number comes again (a run that failed) takes the place of what it wrote, and meets the batches
    before it alone, so that it keeps what it would have kept the first time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def batches(self) -> list[int]:
        """Numbers of the batches that were written to their end, in order."""
        fs, where = stores._fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in (int(x[6:]) for x in names if x.startswith("batch=")) if stores.exists(self.spark, f"{self.path}/batch={n}"))

    def before(self, batch: int) -> DataFrame:
        """The keys of the finished batches below ``batch``."""
        done = [n for n in self.batches() if n < batch]
        if not done:
            return self.spark.createDataFrame([], KEYS)
        paths = [f"{self.path}/batch={n}" for n in done]
        return self.spark.read.schema(KEYS).option("basePath", self.path).parquet(*paths)

    def first(self, rows: DataFrame, key: list[Column], order: list, batch: int) -> DataFrame:
        """The rows of ``rows`` whose key no earlier batch had, and of this batch no earlier row by ``order``.

        Null is a key like any other; of rows equal in key and order any one stays. The kept rows have all
        columns of ``rows`` and ``repeats``: how many rows of this batch have the key besides. The first
        rows of all keys stand in the shared folder until ``release_settled``.
        """
        null = [c.isNull() for c in key]
        # A 128-bit hash stands for the key. Counts are summed in the tasks, and so is the choice of the first row.
        marked = rows.withColumns({"__a": F.xxhash64(*key, *null), "__b": F.xxhash64(F.lit(7), *key, *null)})
        top = marked.withColumn("__n", F.row_number().over(Window.partitionBy("__a", "__b").orderBy(*order))).where("__n = 1").drop("__n")
        times = marked.groupBy("__a", "__b").agg((F.count("*") - 1).alias("repeats"))
        firsts = settled(top.join(times, ["__a", "__b"]).withColumn("__bucket", F.pmod("__a", F.lit(self.buckets)).cast("int")))
        met = [r[0] for r in firsts.select("__bucket").distinct().collect()]  # at most one a bucket
        old = self.before(batch).where(F.col("bucket").isin(met)).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("bucket").alias("__bucket"))
        mine = ["__a", "__b", "__bucket"]
        new = firsts.select(*mine).join(old, mine, "left_anti").toDF("a", "b", "bucket")
        here = f"{self.path}/batch={batch}"
        new.repartition("bucket").sortWithinPartitions("bucket", "a").write.mode("overwrite").partitionBy("bucket").parquet(here)
        kept = self.spark.read.schema("a long, b long, bucket int").parquet(here).toDF(*mine)
        return firsts.join(kept, mine, "left_semi").drop(*mine)
