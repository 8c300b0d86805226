"""Gold by containment: a pair of a text and a query is compared once, however often they meet."""

from pyspark.sql import functions as F

from ragweave.operators import evaluation


def test_pairs_meet_once(spark):
    docs = spark.createDataFrame([(1, "x one two three four y " * 40), (2, "one two three"), (None, "a one two three four b"), (3, "zone two three four."), (4, None), (5, "one two"), (5, "zero one two three four")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four"), (2, "one two three"), (3, "two"), (4, "e two three f"), (5, ""), (6, None), (None, "zone two three four.")], "query_id long, text string")
    got = evaluation.holding(docs, asked)
    want = [tuple(r) for r in docs.crossJoin(asked.withColumnRenamed("text", "qt")).where("contains(text, qt)").select("query_id", "doc_id").collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(xxhash64" not in plan and got.where(F.col("query_id") == 1).count() == 4  # hashes of all places were one array a text before
