"""A vector index of inverted cells: a coarse quantiser fitted on a bounded sample, and every row in a cell.

Centroids come from k-means over at most ``SAMPLE`` rows chosen by hash, in one task; they are
``MAX_CELLS`` at most and broadcast. Every vector is then put into the cell of its nearest centroid,
and cells are partitions of the table; a cell of many rows (copies of a vector, say) is split into parts of some
``PART`` rows. A search sends each query to the ``probes`` cells whose centroids are nearest, reads
only those partitions, and scores their vectors exactly. Recall against the exact scan is a matter of
``probes``; ``probes=None`` is the exact scan.

Null vectors, vectors with a null number and, after the first build, vectors of another size are left
out; all other columns are kept as payload, so a filter may name them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions.session import settled, ship
from ragweave.operators import ranking
from ragweave.sources import stores

SAMPLE = 50_000
MAX_CELLS = 4096
PART = 16_384
ROUNDS = 12


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def scaler(metric: str) -> Callable[[np.ndarray], np.ndarray]:
    """Rows as the quantiser sees them: of length 1 where only the angle counts."""
    return (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)) if metric == "cosine" else (lambda m: m)


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, the nearest first."""
    far = (centroids**2).sum(1)[None] - 2 * vectors @ centroids.T
    n = min(n, len(centroids))
    first = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable"), 1)


def k_means(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids; an empty cell takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest_cells(rows, centroids, 1)[:, 0]
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        far = np.argsort(-((rows - centroids[at]) ** 2).sum(1))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        empty = np.flatnonzero(n == 0)
        centroids[empty] = rows[far[: len(empty)]]
    return centroids


class VectorIndex:
    """Vectors (doc_id, embedding, any payload) in cells below ``path``; a rebuild replaces the whole."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        ship(spark)
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric

    def exists(self) -> bool:
        return stores.exists(self.spark, f"{self.path}/rows")

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> None:
        rows = ranking.sound(vectors)
        sizes = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").head()
        n, size = (sizes["n"], sizes["size"]) if sizes else (0, 1)
        rows = rows.where(F.col("size") == size)
        cells = min(cells or max(1, round(2 * math.sqrt(n))), MAX_CELLS)
        chosen = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id", "embedding"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
        scaled = scaler(self.metric)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [_matrix(b["embedding"], size) for b in batches if len(b)]
            if parts:
                found = scaled(np.concatenate(parts))
                found = k_means(found[np.lexsort(found.T)], cells)  # however the rows came
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], ["cell", "centroid"])

        chosen.select("embedding").repartition(1).mapInArrow(fit, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{self.path}/centroids")
        centroids = self._centroids()
        shared = self.spark.sparkContext.broadcast(centroids)
        fields = [f for f in vectors.schema]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cell = nearest_cells(scaled(_matrix(batch["embedding"], size)), shared.value, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        placed = settled(rows.select(*vectors.columns).mapInArrow(place, f"{kinds}, cell int"))
        placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).write.mode("overwrite").parquet(f"{self.path}/cells")
        counts = self.spark.read.parquet(f"{self.path}/cells")
        placed = placed.join(F.broadcast(counts), "cell")  # a row for each cell
        part = F.pmod(F.xxhash64(F.lit(8), "doc_id", "embedding"), F.col("parts")).cast("int")
        placed = placed.withColumn("part", part).drop("parts")
        writer = placed.repartition("cell", "part").write.mode("overwrite")
        (writer.partitionBy("cell", "part") if n else writer).parquet(f"{self.path}/rows")

    def _centroids(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # MAX_CELLS at most
        return np.array([r["centroid"] for r in found], np.float64) if found else np.zeros((0, 1))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = 16, where: Column | None = None, block: int = PART) -> DataFrame:
        """query_id, doc_id, score and rank of the best vectors of each query (query_id, embedding) in its nearest cells."""
        rows = self.rows()
        rows = rows if where is None else rows.where(where)
        if probes is None:
            return ranking.dense_search(rows, queries, k, self.metric)
        centroids = self._centroids()
        if not len(centroids):
            return ranking.dense_search(rows, queries, k, self.metric)
        shared, scaled, size = self.spark.sparkContext.broadcast(centroids), scaler(self.metric), centroids.shape[1]
        kind = queries.schema["query_id"].dataType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cells = nearest_cells(scaled(_matrix(batch["embedding"], size)), shared.value, probes)
                    yield pa.RecordBatch.from_arrays([batch["query_id"], batch["embedding"], pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], ["query_id", "embedding", "cells"])

        asked = ranking.sound(queries.select("query_id", "embedding")).where(F.col("size") == size).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        m = max(1, -(-asked.count() // block))
        asked = asked.mapInArrow(near, f"query_id {kind}, embedding array<double>, cells array<int>")
        asked = settled(ranking.dealt(asked, "qb", "query_id", m).select("query_id", "embedding", "qb", F.explode("cells").alias("cell")))
        probed = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
        rows = ranking.copied(rows.where(F.col("cell").isin(probed)), "qb", m)
        parts = self.spark.read.parquet(f"{self.path}/cells").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = asked.join(parts, "cell")
        return ranking.top_k(ranking.meet(rows, asked, ["cell", "part", "qb"], k, self.metric), k)
