"""Text embedding with models that each worker loads once, and a content-addressed cache of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig
from ragweave.functions import text as X
from ragweave.operators.chunking import HashedNgrams

#: Per process: model name -> what its ``load`` gave.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


@dataclass(frozen=True)
class Model:
    """An embedder: ``load()`` gives a function from texts to a matrix of ``dimension`` columns."""

    name: str
    dimension: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_ngrams(cfg: ChunkConfig | None = None) -> Model:
    """The built-in model, which needs no files."""
    cfg = cfg or ChunkConfig()
    return Model(f"hashed-ngrams-{cfg.ngram_low}-{cfg.ngram_high}-{cfg.dimensions}", cfg.dimensions, lambda: HashedNgrams(cfg))


def loaded(model: Model) -> Callable[[list[str]], np.ndarray]:
    """The model's function, loaded once in each worker process."""
    if model.name not in _LOADED:
        _LOADED[model.name] = model.load()
    return _LOADED[model.name]


def vectors(model: Model, text: Column, kind: str = "passage") -> Column:
    """Unit vectors of texts, which the model reads behind their ``kind``; equal texts of a batch are embedded once. Null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = loaded(model)
        for batch in batches:
            texts = batch.dropna().unique().tolist()
            found = np.asarray(embed(texts), np.float64).reshape(len(texts), -1) if texts else np.zeros((0, model.dimension))
            if found.shape[1] != model.dimension:
                raise ValueError(f"{model.name} gives {found.shape[1]} numbers, not {model.dimension}")
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            by_text = dict(zip(texts, (found / np.where(norm > 0, norm, 1)).astype(np.float32).tolist(), strict=True))
            yield batch.map(by_text.get)

    return run(X.prefixed(text, kind))


def embedded(df: DataFrame, model: Model, kind: str = "passage", text: str = "text", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, vectors(model, F.col(text), kind))


def with_keys(df: DataFrame, model: Model, kind: str = "passage", text: str = "text") -> DataFrame:
    return df.withColumn("cache_key", X.cache_key(model.name, X.prefixed(F.col(text), kind)))


def missing(df: DataFrame, cache: DataFrame, model: Model, kind: str = "passage", text: str = "text") -> DataFrame:
    """New rows of the cache (cache_key, dimension, embedding): each text that it has no vector of this dimension for, embedded once."""
    asked = with_keys(df, model, kind, text).where(F.col(text).isNotNull()).select("cache_key", F.col(text).alias("text")).dropDuplicates(["cache_key"])
    have = cache.where(F.col("dimension") == model.dimension).select("cache_key")
    new = embedded(asked.join(have, "cache_key", "left_anti"), model, kind)
    return new.select("cache_key", F.lit(model.dimension).alias("dimension"), "embedding")


def from_cache(df: DataFrame, cache: DataFrame, model: Model, kind: str = "passage", text: str = "text") -> DataFrame:
    """``df`` with the cache's vectors of its texts; null where it has none."""
    have = cache.where(F.col("dimension") == model.dimension).select("cache_key", "embedding")
    return with_keys(df, model, kind, text).join(have, "cache_key", "left").drop("cache_key")
