"""Tables that live between runs: vector tables with a fixed dimension, lexical indexes, vector caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ragweave.operators import ranking
from ragweave.sources import catalog

CACHE = "cache_key string, dimension int, embedding array<float>"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    fs, where = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, path: str, mark: str = "") -> list[int]:
    """Numbers of the versions ``path/v=N`` that are finished (or whose part ``mark`` is), in order."""
    fs, where = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in (int(x[2:]) for x in names if x.startswith("v=")) if exists(spark, f"{path}/v={n}/{mark}".rstrip("/")))


class VectorTable:
    """Points (point_id, language, any payload, embedding) of one dimension and metric, partitioned by language.

    An upsert writes a new version and removes the one before the last, so readers of the last go on.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric

    def _meta(self) -> dict | None:
        path = f"{self.path}/meta"
        return json.loads(self.spark.read.text(path).head()["value"]) if exists(self.spark, path) else None

    def exists(self) -> bool:
        return self._meta() is not None

    def create(self, dimension: int, recreate: bool = False) -> None:
        """Make the table, or check that the one there has this dimension."""
        if recreate:
            self.delete()
        meta = self._meta()
        if meta is None:
            self.spark.createDataFrame([(json.dumps({"dimension": dimension, "metric": self.metric}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        elif meta["dimension"] != dimension:
            raise ValueError(f"{self.path} has vectors of {meta['dimension']} numbers, not {dimension}; recreate it")

    def delete(self) -> None:
        remove(self.spark, self.path)

    def dimension(self) -> int | None:
        return (self._meta() or {}).get("dimension")

    def read(self) -> DataFrame | None:
        """The points; None before the first upsert."""
        found = versions(self.spark, self.path)
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def upsert(self, points: DataFrame) -> int:
        """Put points in place of those with their ids; returns how many there are now."""
        size = self.dimension()
        if size is None:
            raise ValueError(f"{self.path} has not been created")
        new, have = catalog.checked_dimension(points, size), self.read()
        rows = new if have is None else catalog.upsert(have, new, "point_id")
        number = (versions(self.spark, self.path) or [0])[-1] + 1
        # In order within files, so that a page skips the row groups that end before it.
        rows.sortWithinPartitions("language", "point_id").write.mode("overwrite").partitionBy("language").parquet(f"{self.path}/v={number}")
        for old in versions(self.spark, self.path)[:-2]:
            remove(self.spark, f"{self.path}/v={old}")
        return self.count()

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def payloads(self) -> DataFrame:
        """The points without their vectors, which are not read."""
        return catalog.index_rows(self.read())

    def page(self, after=None, size: int = 128, languages: list[str] | None = None) -> DataFrame:
        """The next ``size`` payloads by point id, those after ``after``; vectors are not read.

        Each task keeps the least ``size`` of its rows, so no page sorts the table.
        """
        rows = self.payloads()
        if languages:
            rows = rows.where(F.col("language").isin(languages))
        return (rows if after is None else rows.where(F.col("point_id") > F.lit(after))).orderBy("point_id").limit(size)

    def pages(self, after=None, size: int = 128, languages: list[str] | None = None) -> Iterator[list[Row]]:
        """All payloads, a page at a time, each read when it is asked for.

        A reader that stopped goes on with ``after`` = the last point id it had; points put in since then
        are met if their ids are greater. No more than a page is on the driver; for whole scans use ``payloads``.
        """
        while self.read() is not None and (rows := self.page(after, size, languages).collect()):
            yield rows
            if len(rows) < size:
                return
            after = rows[-1]["point_id"]

    def search(self, queries: DataFrame, k: int = 10, languages: list[str] | None = None) -> DataFrame:
        """query_id, doc_id (a point id), score and rank of the nearest points of each query (query_id, embedding)."""
        rows = self.read().select(F.col("point_id").alias("doc_id"), "language", "embedding")
        return ranking.dense_search(rows, queries, k, self.metric, F.col("language").isin(languages) if languages else None)


def fingerprint(df: DataFrame) -> str:
    """A digest of the files that ``df`` reads: paths, sizes and times of change."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(38, 0)")).alias("h")).head()
    return hashlib.sha256(f"{found['n']}:{found['h']}".encode()).hexdigest()[:24]


def cache(spark: SparkSession, path: str) -> DataFrame:
    """A vector cache (cache_key, dimension, embedding); empty if there is none yet."""
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
