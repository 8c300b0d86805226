"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are range-sorted: the key space
is cut into equal ranges of some 2,000 documents, each range is sorted in one task, and the sizes
of the ranges before it are added to the running sum (a distributed prefix sum). Each source is
then cut at its exact budget; a budget above the source's size repeats whole epochs first.

A hot source has many ranges, and rows equal in id, source and text are counted before they are
ordered, so no task orders more than a range. Only per-source and per-range sums are brought
together. The order depends on ids, texts and seed alone, so reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows
that share an id, or have none, are documents of their own; rows equal in id, source and text are
interchangeable (``mix_documents`` takes one of them as often as the mix takes them all); an empty
table gives no rows; columns other than doc_id, text and source are not looked at
(``mix_documents`` passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm.common import WORD, Tables, join_checked, one_of_equals

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 2048


def hash_key(seed: int) -> Column:
    """The hash-random key of a document, from its id and text (hex, uniform)."""
    part = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    return F.md5(F.concat(F.lit(f"{seed}:"), part("doc_id", "null"), F.lit(":"), F.md5(part("text", ""))))


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words and the hash-random key of each document."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash_key(seed).alias("key"),
    )


def targets(stats: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of sources (source, source_size; one row per source).

    Sources in code-point order weigh ``weights`` repeating. The level at which weight times level
    exhausts the total is found on sources sorted by cap per weight, where the capped sources are
    a prefix: this is the fixed point of resharing the excess until no target is above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = stats.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    s = s.withColumns({"total": total, "all_w": F.sum("w").over(every), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("capped", F.col("ratio") <= (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    cap_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    w_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(every), F.lit(0.0))
    s = s.withColumns({"cap_sum": cap_sum, "w_sum": w_sum})
    share = F.col("w") * (F.col("total") - F.col("cap_sum")) / F.nullif(F.col("all_w") - F.col("w_sum"), F.lit(0.0))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 20) -> DataFrame:
    """doc_id, source, size, key, source_size, target, taken, before, left, epochs: the words the mix takes of each row.

    ``taken`` sums to the rounded target of each source exactly: the document at the cut gives its
    leading words. ``before`` is the prefix sum up to the document, ``left`` the budget of the last,
    partial epoch and ``epochs`` the number of whole ones.
    """
    tables = Tables(docs.sparkSession)
    slim = tables.write(sizes(docs, seed).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows")))
    stats = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    stats = targets(stats, weights, max_epochs).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "source_size", "target",
        F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"),
        F.round("target").cast("long").alias("budget"),
    )
    stats = tables.write(stats, 1)
    fraction = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranged = join_checked(slim.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), stats, "src")
    ranged = ranged.withColumn("range", F.floor(fraction * F.col("ranges")))
    every = F.col("size") * F.col("rows")
    sums = ranged.groupBy("src", "range").agg(F.sum(every).alias("range_size"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = tables.write(sums.select("src", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("src", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("inside", F.coalesce(F.sum(every).over(inside), F.lit(0)))
    out = join_checked(out, sums, ["src", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth"))  # equal rows one after the other
    out = out.withColumns({"before": F.col("offset") + F.col("inside") + F.col("nth") * F.col("size"), "epochs": epochs})
    out = out.withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(F.col("left") - F.col("before"), F.lit(0)), F.col("size"))
    return out.select("doc_id", "source", "size", "key", "source_size", "target", taken.cast("long").alias("taken"), "before", "left", "epochs")


def copies(mixed: DataFrame) -> Column:
    """Whole copies of a document: its epochs, and one more if at least half of it lies before the cut."""
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("epochs") + ((F.col("before") + F.col("size") / 2) <= F.col("left")).cast("long"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 20) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document stands as often as the mix takes it whole.

    Documents without words are not taken.
    """
    tables = Tables(docs.sparkSession)
    mixed = mix(docs, weights, max_epochs, seed)
    same = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key")]
    n = mixed.groupBy(*same).agg(F.sum(copies(mixed)).alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    n = tables.write(n)
    keyed = docs.withColumns({"__at": hash_key(seed), "__from": F.col("source").cast("string")})
    match = (F.col("__at") == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id")) & F.col("__from").eqNullSafe(F.col("__source"))
    out = join_checked(keyed, n, match)
    once = out.where("__rows = 1").select(*docs.columns, "__copies")
    if not n.where("__rows > 1").isEmpty():
        once = once.unionByName(one_of_equals(out.where("__rows > 1"), ["__key", "__id", "__source"], [*docs.columns, "__copies"]))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM s1),
s3 AS (SELECT *, ratio <= (total - cap_before) / (all_w - w_before) AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
  ELSE w * CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) / (all_w - coalesce(sum(w) FILTER (capped) OVER (), 0)) END AS target FROM s3),
s5 AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM s4),
r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.budget,
  CASE WHEN s5.source_size > 0 THEN s5.budget // s5.source_size ELSE 0 END AS epochs,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM r
"""
