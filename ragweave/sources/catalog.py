"""Sources and sinks: shard catalogs, JSON Lines, keyed upserts, index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.functions import text as X

META = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("temperature", T.DoubleType()), T.StructField("max_tokens", T.LongType()),
    T.StructField("top_p", T.DoubleType()), T.StructField("frequency_penalty", T.DoubleType()), T.StructField("presence_penalty", T.DoubleType()),
])
RAW = T.StructType([
    T.StructField("source_lang", T.StringType()), T.StructField("target_lang", T.StringType()), T.StructField("meta", META), T.StructField("Answer", T.StringType()),
    T.StructField("query_id", T.StringType()), T.StructField("query_type", T.StringType()),
    T.StructField("passages", T.StructType([T.StructField("English_passages", T.ArrayType(T.StringType())), T.StructField("Translated_passages", T.ArrayType(T.StringType())), T.StructField("is_selected", T.ArrayType(T.StringType()))])),
    T.StructField("Eng_Query", T.StringType()), T.StructField("Eng_Answer", T.StringType()), T.StructField("query", T.StringType()),
])
PASSAGE = "document_id string, query_id string, passage_index int, text string, language string, language_flores string, is_selected boolean, passage_source string, char_length int, shard_lang string, split string, query_type string"


def shards(paths: DataFrame) -> DataFrame:
    """path, split, stem and lang of shard files among ``paths`` (path); unknown stems go."""
    file = r"^(?:.*/)?(train|validation)/([a-z]+?)(?:train|val)\.parquet$"
    df = paths.select("path", F.regexp_extract("path", file, 1).alias("split"), F.regexp_extract("path", file, 2).alias("stem"))
    known = F.create_map(*(F.lit(x) for k, v in X.LANGUAGE_STEMS.items() for x in (k, v)))
    return df.where("split != ''").withColumn("lang", F.try_element_at(known, F.col("stem"))).where("lang is not null")


def list_shards(spark: SparkSession, root: str) -> DataFrame:
    """Shards below a folder, from any file system Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return shards(files.select("path"))


def reported_shards(report: str | None) -> dict[str, dict[str, str]] | None:
    """{split: {lang: path}} of a cached report's JSON text; None if there is none in it."""
    found = (json.loads(report) if report else {}).get("shards")
    return found or None


def discover(spark: SparkSession, report: str | None, root: str) -> DataFrame:
    """The catalog that a cached report has, else that of the files below ``root``."""
    known = reported_shards(report)
    if known is None:
        return list_shards(spark, root)
    rows = [(path, split, lang) for split, by in known.items() for lang, path in by.items()]
    return spark.createDataFrame(rows, "path string, split string, lang string")


def languages(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split).select("lang").distinct().orderBy("lang")


def resolve(df: DataFrame, lang: str, split: str) -> str:
    """The path of a shard. KeyError names what there is."""
    rows = df.where((F.col("split") == split) & (F.col("lang") == lang)).select("path").limit(1).collect()
    if not rows:
        have = ", ".join(r["lang"] for r in languages(df, split).collect())
        raise KeyError(f"no {split} shard of {lang!r}; there are {have or 'none'}")
    return rows[0]["path"]


def missing_languages(requested: list[str], df: DataFrame, split: str) -> list[str]:
    spark = df.sparkSession
    asked = spark.createDataFrame([(x,) for x in requested], "lang string")
    return [r["lang"] for r in asked.subtract(languages(df, split)).orderBy("lang").collect()]


def read_raw(spark: SparkSession, path: str, lang: str, split: str) -> DataFrame:
    """Raw rows of a shard, under the fixed schema."""
    have = spark.read.parquet(path)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW]
    return have.select(*columns, F.lit(lang).alias("shard_lang"), F.lit(split).alias("split"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages of JSON Lines; malformed lines are left out."""
    return spark.read.schema(PASSAGE).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines of which a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(have: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """``have`` with the rows of ``new`` in place of those with their keys; of equal new keys the last by ``order``."""
    if order is not None:
        from pyspark.sql import Window

        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")
    return have.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def checked_dimension(df: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """Rows whose vectors have ``size`` entries; any other raises when it is read."""
    wrong = F.concat(F.lit(f"a vector has another size than {size}: "), F.size(column).cast("string"))
    return df.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(wrong)))


def cache_misses(wanted: DataFrame, cache: DataFrame, dimension: int) -> DataFrame:
    """Rows (cache_key) that the cache has no vector of this dimension for."""
    return wanted.join(cache.where(F.size("embedding") == dimension), "cache_key", "left_anti")


def cache_hits(wanted: DataFrame, cache: DataFrame, dimension: int) -> DataFrame:
    return wanted.join(cache.where(F.size("embedding") == dimension), "cache_key")


def statistics(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("dimension"))


def flattened(kind: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of a schema's leaves; those in arrays of structs have ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in flattened(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return flattened(kind.elementType, f"{prefix}[]")
    return [prefix]


def write_report(df: DataFrame, path: str) -> None:
    """A report as one JSON object a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def index_rows(df: DataFrame) -> DataFrame:
    """An index's payload; vectors are not read."""
    return df.drop("embedding")


def document_ids(df: DataFrame) -> DataFrame:
    return df.select("document_id").where("document_id is not null and document_id != ''").distinct()
