"""Runs from the command line: ``python -m ragweave COMMAND ...``; each prints its report as one JSON object."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig, IngestConfig, RetrievalConfig
from ragweave.functions.session import release_settled
from ragweave.operators import chunking, embedding, evaluation, routing
from ragweave.plans import runs
from ragweave.sources import catalog, stores
from ragweave.sources.lexical import LexicalStore


def _questions(spark: SparkSession, path: str) -> DataFrame:
    return runs.load_queries(spark, path).select(F.col("query_id").alias("query_id"), F.col("query").alias("text"))


def ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = catalog.discover(spark, None, a.source)
    languages = a.languages.split(",") if a.languages else [r["lang"] for r in catalog.languages(found, a.split).collect()]
    base = IngestConfig.from_env()
    cfg = IngestConfig(**{**base.__dict__, "split": a.split, "dedupe": a.dedupe or base.dedupe, "examples_per_language": a.limit or base.examples_per_language})
    return runs.ingest_run(spark, found, languages, a.out, cfg)


def index(spark: SparkSession, a: argparse.Namespace) -> dict:
    passages = catalog.read_passages(spark, a.source)
    report = runs.index_run(spark, passages, a.out, a.strategy, cfg=ChunkConfig.from_env(), recreate=a.recreate)
    chunks = spark.read.parquet(f"{a.out}/chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    LexicalStore(spark, f"{a.out}/lexical", RetrievalConfig.from_env()).sync(chunks.dropDuplicates(["doc_id"]))
    return report


def search(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Lexical and dense hits of an evaluation set's queries over an index, as tables."""
    asked = _questions(spark, a.source)
    lexical = LexicalStore(spark, f"{a.index}/lexical", RetrievalConfig.from_env())
    near = embedding.embedded(asked, embedding.hashed_ngrams(ChunkConfig.from_env()), "query").select("query_id", "embedding")
    counts = {}
    for name, hits in (("lexical", lexical.search(asked, a.k)), ("dense", stores.VectorTable(spark, f"{a.index}/vectors").search(near, a.k))):
        hits.write.mode("overwrite").parquet(f"{a.out}/{name}")
        counts[name] = spark.read.parquet(f"{a.out}/{name}").count()
    return counts


def route(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = routing.features(_questions(spark, a.source)).groupBy("route").agg(F.count("*").alias("n")).collect()
    return {r["route"]: r["n"] for r in rows}


def chunk(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Chunk metrics of each strategy over the same passages."""
    passages = chunking.passages(catalog.read_passages(spark, a.source))
    out: dict = {"passages": evaluation.passage_stats(passages).head().asDict()}
    for strategy in chunking.STRATEGIES:
        rows = evaluation.chunk_metrics(chunking.chunks(passages, strategy, ChunkConfig.from_env()), passages).collect()
        out[strategy] = rows[0].asDict() if rows else {}
    return out


def inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Ids, blanks, lists and fields of the raw shards of a split."""
    raw = None
    for r in catalog.discover(spark, None, a.source).where(F.col("split") == a.split).collect():  # one a language
        rows = catalog.read_raw(spark, r["path"], r["lang"], r["split"])
        raw = rows if raw is None else raw.unionByName(rows)
    if raw is None:
        return {"shards": 0}
    fields = evaluation.field_profile(raw.select("query_id", "query_type", "query", "Eng_Query", "Answer", "Eng_Answer"))
    return evaluation.inspected(raw).head().asDict() | {"paths": catalog.flattened(raw.schema), "fields": {r["field"]: r.asDict() for r in fields.collect()}}


COMMANDS = {f.__name__: f for f in (ingest, index, search, route, chunk, inspect)}


def main(argv: list[str], spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="ragweave")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("source", help="a folder of shards or passages, or an evaluation set")
    parser.add_argument("--out", default="ragweave-out")
    parser.add_argument("--index", default="ragweave-out")
    parser.add_argument("--split", default="validation")
    parser.add_argument("--languages", help="comma-separated; all of the catalog's if left out")
    parser.add_argument("--limit", type=int, help="examples of each language")
    parser.add_argument("--strategy", default="adaptive", choices=chunking.STRATEGIES)
    parser.add_argument("--k", type=int, default=10)
    parser.add_argument("--dedupe", action="store_true")
    parser.add_argument("--recreate", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ragweave").getOrCreate()
    report = COMMANDS[a.command](spark, a)
    release_settled(spark)  # all commands have written their results
    print(json.dumps(report, ensure_ascii=False, default=str))
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
