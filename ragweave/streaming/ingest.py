"""Incremental indexing: passages arrive as JSON Lines, chunks are upserted by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig
from ragweave.operators import chunking
from ragweave.sources import catalog, stores

#: Batches between two compactions.
COMPACT_EVERY = 16


def passages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(catalog.PASSAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, strategy: str = "structure", cfg: ChunkConfig | None = None, compact_every: int = COMPACT_EVERY):
    """Index what is in ``folder`` and what comes; returns the query. Batches can be repeated without effect.

    A batch writes its own chunks only, as ``table/delta/v=N``. Every ``compact_every`` batches what
    holds by then is written as ``table/base/v=N``, and what it replaces is removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        made = chunking.first_of_each(chunking.chunks(chunking.passages(batch), strategy, cfg))
        made.write.mode("overwrite").parquet(f"{table}/delta/v={number}")
        if (number + 1) % compact_every == 0:
            compact(spark, table, number)

    rows = passages(spark, folder)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, table: str, number: int) -> None:
    """Write what holds after batch ``number`` as one table, and remove older bases and their deltas."""
    rows = current(spark, table, upto=number)
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(f"{table}/base/v={number}")
    for kind, last in (("base", number - 1), ("delta", number)):
        for v in stores.versions(spark, f"{table}/{kind}"):
            if v <= last:
                stores.remove(spark, f"{table}/{kind}/v={v}")


def current(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame | None:
    """The chunks that hold (after a batch number, if given): of each id the last batch's; None if there are none."""
    allowed = lambda kind: [v for v in stores.versions(spark, f"{table}/{kind}") if upto is None or v <= upto]
    base = max(allowed("base"), default=None)
    parts = [("base", base)] if base is not None else []
    parts += [("delta", v) for v in allowed("delta") if base is None or v > base]
    out = None
    for kind, v in parts:
        rows = spark.read.parquet(f"{table}/{kind}/v={v}").withColumn("__batch", F.lit(v))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None or len(parts) == 1:
        return None if out is None else out.drop("__batch")
    last = out.groupBy("chunk_id").agg(F.max("__batch").alias("__batch"))  # ids only; the rows are joined to them
    return out.join(last, ["chunk_id", "__batch"]).drop("__batch")
