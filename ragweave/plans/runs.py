"""Whole runs, from sources to written tables and a report: ingest, index, evaluation set, latencies."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig, IngestConfig
from ragweave.functions import measures as M
from ragweave.functions import text as X
from ragweave.operators import chunking, embedding, evaluation, ingest
from ragweave.sources import catalog, shard_source, stores

#: Errors that a report lists.
ERRORS = 50


def _one(df: DataFrame) -> dict:
    return df.head().asDict()


def _counts(df: DataFrame) -> dict:
    """{dimension: {value: n}} of a distribution, the most frequent first."""
    out: dict = {}
    for r in df.orderBy("dimension", F.desc("n"), "value").collect():  # languages, types and routes
        out.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    return out


def ingest_run(spark: SparkSession, shards: DataFrame | dict, languages: list[str], out: str, cfg: IngestConfig | None = None) -> dict:
    """Ingest the shards of ``languages``: examples and passages as JSON Lines below ``out``, and a report, which is returned and written.

    ``shards`` is a catalog or what a report had of one ({split: {lang: path or paths}}). The source is read
    once: what was seen and given is observed while the examples are written. A shard that can't be
    opened is an error in the report, of which it has the first ``ERRORS``; the others go on.
    """
    cfg, began = cfg or IngestConfig(), time.time()
    have = (shards if isinstance(shards, dict) else shard_source.catalog_of(shards)).get(cfg.split, {})
    errors = [f"{lang}: no {cfg.split} shard; there are {', '.join(sorted(have)) or 'none'}" for lang in languages if lang not in have]
    raw = shard_source.read(spark, {cfg.split: {lang: have[lang] for lang in languages if lang in have}}, cfg.examples_per_language)
    seen, failed, given, before = (Observation(n) for n in ("seen", "failed", "given", "before"))
    failures = F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "shard_lang", "error")))  # a row a part of a shard at most
    raw = raw.observe(failed, failures.alias("errors"), F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.col("shard_lang")))).alias("languages"))
    clean = ingest.examples(raw.where("error is null"), cfg, seen).observe(before, F.coalesce(F.sum(F.size("passages")), F.lit(0)).alias("passages"))
    clean = ingest.deduped(clean, cfg.dedupe_scope) if cfg.dedupe else clean
    clean.observe(given, *ingest.given_metrics()).write.mode("overwrite").parquet(f"{out}/clean")
    clean = spark.read.parquet(f"{out}/clean")  # both sinks read what was cleaned once
    catalog.write_jsonl(clean, f"{out}/examples")
    catalog.write_jsonl(ingest.exploded(clean).drop("seq"), f"{out}/passages")
    report = {"split": cfg.split, "languages": sorted(failed.get["languages"], key=languages.index), "errors": (sorted(failed.get["errors"]) + errors)[:ERRORS]}
    report |= seen.get | given.get | {"passages_deduped": before.get["passages"] - given.get["passages_emitted"]} | _counts(ingest.distributions(clean))
    report["seconds"] = round(time.time() - began, 3)
    return written(spark, report, f"{out}/report")


def written(spark: SparkSession, report: dict, path: str) -> dict:
    """Write a report as one JSON object and return it."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return report


def load_passages(spark: SparkSession, path: str | None, limit: int, languages: tuple[str, ...] = (), fallback: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` passages of JSON Lines (a file, or a folder written to its end); without one, of ``fallback``, evenly by language."""
    if path and (stores.is_file(spark, path) or stores.exists(spark, path)):
        rows = catalog.read_passages(spark, path)
        return (rows.where(F.col("language").isin(*languages)) if languages else rows).limit(limit)
    if fallback is None:
        raise ValueError("there are neither written passages nor others")
    rows = fallback.where(F.col("language").isin(*languages)) if languages else fallback
    share = -(-limit // max(1, len(languages) or rows.select("language").distinct().count()))
    return ingest.per_language(rows.withColumn("shard_lang", F.col("language")), share, ["document_id"]).limit(limit)


def index_run(spark: SparkSession, passages: DataFrame, path: str, strategy: str = "adaptive", model: embedding.Model | None = None, cfg: ChunkConfig | None = None, recreate: bool = False) -> dict:
    """Chunk passages, embed what the cache below ``path`` hasn't got, and upsert the points; returns counters."""
    model, began = model or embedding.hashed_ngrams(cfg), time.time()
    table = stores.VectorTable(spark, f"{path}/vectors")
    table.create(model.dimension, recreate)
    passages = chunking.passages(passages)
    every = chunking.chunks(passages, strategy, cfg)
    every.write.mode("overwrite").parquet(f"{path}/chunks")
    every = spark.read.parquet(f"{path}/chunks")
    once = chunking.first_of_each(every)
    at = time.time()
    old = stores.cache(spark, f"{path}/cache")
    embedding.missing(once, old, model).write.mode("append").parquet(f"{path}/cache")
    cache = stores.cache(spark, f"{path}/cache")
    seconds = time.time() - at
    points = embedding.from_cache(once, cache.dropDuplicates(["cache_key", "dimension"]), model).withColumn("point_id", X.name_uuid(F.col("chunk_id")))
    total = table.upsert(points)
    counted = _one(every.agg(F.count("*").alias("produced"), F.count_distinct("chunk_id").alias("chunks_indexed")))
    read = _one(passages.agg(F.count("*").alias("n"), F.count_if(F.size(X.sentences(F.col("text"))) == 0).alias("without")))
    return {
        "strategy": strategy, "model": model.name, "dimension": model.dimension, "passages": read["n"], "passages_without_chunks": read["without"], "chunks_indexed": counted["chunks_indexed"],
        "duplicate_chunks": counted["produced"] - counted["chunks_indexed"], "cached_vectors": cache.count(), "points": total, "embedding_seconds": round(seconds, 3), "seconds": round(time.time() - began, 3),
    }


def evaluation_run(spark: SparkSession, examples: DataFrame, out: str, cap: int | None = None, indexed: DataFrame | None = None, include_english: bool = True) -> dict:
    """Write the evaluation set as JSON Lines and return its report with histograms of languages, routes and types."""
    rows = evaluation.gold_set(examples, indexed, include_english)
    rows = evaluation.stratified(rows, cap, ["query_id", "query_source"]).drop("turn") if cap else rows
    catalog.write_jsonl(rows, out)
    rows = spark.read.schema(rows.schema).json(out)
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value")) for c in ("query_language", "expected_route", "query_type")))
    found = rows.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return _one(evaluation.gold_report(examples, indexed, include_english)) | {"queries": rows.count()} | _counts(found)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set of JSON Lines, blanks for what is missing."""
    schema = "query_id string, query string, query_language string, gold_document_ids array<string>, query_type string, expected_route string"
    rows = catalog.read_strict(spark, path, schema)
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("query", "query_language", "query_type", "expected_route")}
    return rows.withColumns(text | {"gold_document_ids": F.coalesce("gold_document_ids", F.array().cast("array<string>"))})


def latencies(rows: DataFrame, stages: list[str]) -> DataFrame:
    """mean, median (p50), p70 and p100 of each stage's column, and of their sum, one row each."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages[1:]), F.coalesce(F.col(stages[0]), F.lit(0.0)))
    pairs: list[Column] = [F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in stages]
    pairs.append(F.struct(F.lit("total").alias("stage"), total.cast("double").alias("ms")))
    every = rows.select(F.inline(F.array(*pairs)))
    return M.beside_groups(every.groupBy("stage").agg(F.count("ms").alias("n")), M.latency(every, ["stage"], "ms"), ["stage"])


def warm_up(spark: SparkSession, parts: dict[str, DataFrame], models: tuple[embedding.Model, ...] = (), probe: DataFrame | None = None) -> dict[str, float]:
    """Read each table once, load the models in the workers, so that later runs find files listed and models loaded; seconds by name.

    A task for each core embeds one text with each model; a core whose worker gets no task loads it later.
    ``probe``, the plan of a small request, is run last and timed as "warm_request".
    """
    out: dict[str, float] = {}

    def timed(name: str, run) -> None:
        at = time.time()
        run()
        out[name] = round(time.time() - at, 3)

    for name, df in parts.items():
        timed(name, df.limit(1).count)
    cores = spark.sparkContext.defaultParallelism
    for model in models:
        texts = spark.range(0, cores, 1, cores).select(embedding.vectors(model, F.concat(F.lit("warm-up "), F.col("id").cast("string"))))
        timed(model.name, texts.write.format("noop").mode("overwrite").save)
    if probe is not None:
        timed("warm_request", probe.write.format("noop").mode("overwrite").save)
    return out
