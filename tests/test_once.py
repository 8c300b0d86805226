"""Texts are measured once, however many passes percentiles take."""

from pyspark.sql import functions as F

from ragweave.operators import evaluation


def counted(spark, folder):
    """Ten texts, and a function that counts how often one was computed."""
    log = f"{folder}/calls"

    @F.udf("string")
    def text(i):
        with open(log, "a") as f:
            f.write("x\n")
        return "One two. Three four? " * (i + 1)

    df = spark.range(10).select("id", text.asNondeterministic()("id").alias("text"), F.lit("en").alias("language"))
    return df, lambda: sum(1 for _ in open(log))


def test_lengths_are_taken_once(spark, tmp_path):
    df, calls = counted(spark, tmp_path)
    assert evaluation.length_profile(df, "language").collect()[0]["n"] == 10 and calls() == 10


def test_chunks_are_cut_once(spark, tmp_path):
    df, calls = counted(spark, tmp_path)
    chunks = df.select(F.lit("s").alias("chunk_strategy"), F.col("id").cast("string").alias("document_id"), F.length("text").alias("char_length"), F.lit(2).alias("sentence_count"))
    passages = spark.range(12).select(F.col("id").cast("string").alias("document_id"), F.lit(True).alias("is_selected"))
    row = evaluation.chunk_metrics(chunks, passages).collect()[0]
    assert (row["chunks"], row["zero_chunk_passages"], row["gold_coverage_pct"], row["max_chars"]) == (10, 2, 83.33, 210) and calls() == 10
