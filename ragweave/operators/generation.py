"""Answer generators: an extractive one in the JVM, and a wrapper for injected clients."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.functions.session import ship
from ragweave.operators import guardrails

RESPONSES = "prompt_key string, raw string, error string, attempts int"


def extractive(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``raw``: JSON whose answer is the evidence sentence that has most of the query's tokens.

    Without evidence it says insufficient_context. ``strict`` gives the same, as quoting can't get stricter.
    """
    asked = X.content_tokens(F.col("text"))
    df = df.select("*", F.inline(F.array(F.struct(asked.alias("__q")))))

    def best(k: Column, i: Column) -> Column:
        return F.transform(X.sentences(k["text"]), lambda s, j: F.struct(X.coverage(F.col("__q"), X.tokens(s)).alias("share"), (-i).alias("i"), (-j).alias("j"), s.alias("s"), k["doc_id"].cast("string").alias("id")))

    top = F.array_max(F.flatten(F.transform("items", best)))
    df = df.select("*", F.inline(F.array(F.struct(top.alias("__top"))))).drop("__q")
    made = F.to_json(F.struct(F.col("__top.s").alias("answer"), F.lit("grounded").alias("status"), F.array(F.struct(F.col("__top.id").alias("chunk_id"))).alias("sources")))
    none = F.to_json(F.struct(guardrails.refusal(F.col("language")).alias("answer"), F.lit("INSUFFICIENT_CONTEXT").alias("status")))
    return df.withColumn("raw", F.when(F.col("__top").isNotNull(), made).otherwise(none)).drop("__top")


def injected(complete: Callable[[str, str], str], system: str, strict_system: str | None = None, retries: int = 2, wait: float = 0.0) -> Callable[[DataFrame, bool], DataFrame]:
    """A generator from a client ``complete(system, prompt)``; what fails ``retries + 1`` times gives a null ``raw``."""

    def generate(df: DataFrame, strict: bool = False) -> DataFrame:
        said = (strict_system or system) if strict else system

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(prompt: str) -> str | None:
                for attempt in range(retries + 1):
                    try:
                        raw = complete(said, prompt)
                        if isinstance(json.loads(raw[raw.find("{") : raw.rfind("}") + 1]), dict):
                            return raw
                    except Exception:  # any client error is data: it ends as llm_error
                        time.sleep(wait * (attempt + 1))
                return None

            for batch in batches:
                yield batch.map(one)

        return df.withColumn("raw", run(guardrails.prompt(F.col("text"), F.col("language"), F.col("items"))))

    return generate


def error_kind(e: Exception) -> str:
    """timeout, rate_limited, connection, invalid_json or client_error."""
    if isinstance(e, TimeoutError):
        return "timeout"
    if getattr(e, "status_code", None) == 429 or "ratelimit" in type(e).__name__.lower():
        return "rate_limited"
    if isinstance(e, ConnectionError):
        return "connection"
    return "invalid_json" if isinstance(e, ValueError) else "client_error"


def _asked(complete: Callable[[str, str], str], said: str, prompt: str, retries: int, wait: float) -> tuple[str | None, str | None, int]:
    """What a client says to a prompt, or the kind of its last error, and how often it was asked."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            raw = complete(said, prompt)
            if not isinstance(json.loads(raw[raw.find("{") : raw.rfind("}") + 1]), dict):
                raise ValueError("no object")
            return raw, None, attempt
        except Exception as e:  # any client error is data
            error = error_kind(e)
            if attempt <= retries:
                time.sleep(wait * attempt)
    return None, error, attempt


def kept(complete: Callable[[str, str], str], path: str, system: str, strict_system: str | None = None, retries: int = 2, wait: float = 0.0, concurrency: int = 8, tasks: int = 8, wave: int = 10_000) -> Callable[[DataFrame, bool], DataFrame]:
    """A generator whose answers are kept in the table ``path`` (prompt_key, raw, error, attempts).

    A prompt is asked once, however many questions have it and however often the plan runs: only keys
    without an answer go to the client, in waves of some ``wave`` prompts, each of which is appended when
    it is done, so a run that stops asks at most one wave again. A task asks ``concurrency`` prompts at
    a time, and ``tasks`` tasks do. What fails ``retries + 1`` times is kept with its error, gives a null
    ``raw``, and is asked again by the next run. The client is called while the plan is built.
    """

    def generate(df: DataFrame, strict: bool = False) -> DataFrame:
        from ragweave.sources import stores

        spark, said = df.sparkSession, (strict_system or system) if strict else system
        ship(spark)
        prompt = guardrails.prompt(F.col("text"), F.col("language"), F.col("items"))
        keyed = lambda c: F.sha2(F.concat(F.lit(said), F.lit("\0"), c), 256)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(concurrency) as pool:
                for batch in batches:
                    said_ = list(pool.map(lambda p: _asked(complete, said, p, retries, wait), batch["prompt"]))
                    yield pd.DataFrame({"prompt_key": batch["prompt_key"], "raw": [x[0] for x in said_], "error": [x[1] for x in said_], "attempts": [x[2] for x in said_]})

        def answers() -> DataFrame:
            return spark.read.schema(RESPONSES).parquet(path) if stores.exists(spark, path) else spark.createDataFrame([], RESPONSES)

        wanted = df.select(prompt.alias("prompt")).where("prompt is not null").distinct().withColumn("prompt_key", keyed(F.col("prompt")))
        new = wanted.join(answers().where("error is null").select("prompt_key"), "prompt_key", "left_anti")
        waves = -(-new.count() // wave)
        for k in range(waves):
            mine = new.where(F.pmod(F.xxhash64("prompt_key"), F.lit(waves)) == k)  # what was answered before this run or not at all
            done = mine.join(answers().where("error is null").select("prompt_key"), "prompt_key", "left_anti").repartition(tasks, "prompt_key")
            done.mapInPandas(run, RESPONSES).write.mode("append").parquet(path)
        best = answers().groupBy("prompt_key").agg(F.max("raw").alias("raw"), F.max("error").alias("error"), F.sum("attempts").cast("int").alias("attempts"))
        best = best.withColumn("error", F.when(F.col("raw").isNull(), F.col("error")))
        return df.withColumn("prompt_key", keyed(prompt)).join(best, "prompt_key", "left").drop("prompt_key")

    return generate
