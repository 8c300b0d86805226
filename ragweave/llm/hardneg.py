"""Hard-negative mining by norm-bucketed search.

Vectors are quantised, and buckets are quantiles of their squared length, the longest first; a large
bucket (and, among rows of an anchor's own label, each label's part of it) is dealt over blocks of
some ``BLOCK`` rows by hash. No inner product with an anchor exceeds the product of both lengths
(Cauchy-Schwarz), so an anchor is sent only to buckets whose longest row can reach what it still
needs: the first buckets are searched in a wave of their own, and in the later wave an anchor's need is
its running fifth positive, or the least over its windows of the lower limit and the running third
negative. Anchors that need nothing more of a bucket are not sent there.

A block meets the anchors in blocks of some ``BLOCK`` as well: a task holds two blocks and one slab of
their product, whatever the input, the label or the bucket. All rows but those that the bounds rule out
are searched, so results are exact.

Defined results: rows with a null label, vector or id, a null or non-finite component, or a squared
length of 2^62 or more after quantising (whose products may not fit a long) take no part; vectors of
different sizes meet as if zeros followed the shorter one; rows equal in id, label and vector count
once, and rows that share an id are otherwise rows of their own, none of which is a positive of its
namesake; equal scores and ids are in the order of label, then of the vector's hash; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm.common import Tables

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
BUCKETS = 64
#: Rows of a block, and of anchors that meet it at once.
BLOCK = 8192
SLAB = 256
#: Share of the buckets in the first wave.
FIRST = 0.25


def rows_of(vectors: DataFrame, scale: int = 256, every: int = 50, moved: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, q (quantised), norm2, h (hash of the row) and anchor of the rows that take part."""
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    df = df.where("vec_id is not null and label is not null and x is not null").where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    df = df.withColumn("f", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)))  # beyond a long: its end, which is too long anyhow
    df = df.where(F.aggregate("f", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < float(1 << 62))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    df = df.select("vec_id", label.alias("label"), F.col("f").alias("q"))
    df = df.select("*", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm2"), F.xxhash64("vec_id", "label", "q").alias("h"))
    return df.withColumn("anchor", F.col("vec_id") % every == 0)


def bucketed(rows: DataFrame, tables: Tables, buckets: int = BUCKETS) -> DataFrame:
    """Written rows with their bucket (0 holds the longest); repeats of a row are gone."""
    rows = tables.write(rows)  # read for the quantiles and again to be dealt
    bounds = rows.agg(F.percentile_approx("norm2", [i / buckets for i in range(1, buckets)], F.lit(10_000))).head()[0] or []
    edges = F.array(*(F.lit(b).cast("long") for b in sorted(set(bounds), reverse=True))) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e > F.col("norm2"))))
    first = F.row_number().over(Window.partitionBy("vec_id", "label", "h").orderBy("norm2"))  # no column but these differs
    return tables.write(rows.withColumn("__n", first).where("__n = 1").drop("__n"))


def _stack(lists, size: int) -> np.ndarray:
    """Vectors as rows, zeros after the shorter ones."""
    out = np.zeros((len(lists), size), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both; by way of float64, which is exact below 2^53, where the lengths allow."""
    longest = [float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0))) for m in (a, b)]
    if longest[0] * longest[1] < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _in_order(block: pd.DataFrame) -> pd.DataFrame:
    return block.sort_values(["vec_id", "label", "h"], kind="stable", ignore_index=True)


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], found, kinds: str) -> DataFrame:
    """Blocks of rows held against the blocks of anchors with their keys.

    ``found(scores, anchor, rows)`` gives the positions and the extra columns of what an anchor keeps of a block.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        if len(left) and len(right):
            right = _in_order(right)
            size = max(left["q"].map(len).max(), right["q"].map(len).max())
            theirs = _stack(right["q"].to_numpy(), size)
            ids, labels, hashes = (right[c].to_numpy() for c in ("vec_id", "label", "h"))
            for at in range(0, len(left), SLAB):
                slab = left.iloc[at : at + SLAB]
                scores = _products(_stack(slab["q"].to_numpy(), size), theirs)
                for s, anchor in zip(scores, slab.itertuples(index=False), strict=True):
                    for window, picked in found(s, anchor, ids, labels):
                        parts.append((np.full(len(picked), anchor.h), np.full(len(picked), window), ids[picked], labels[picked], hashes[picked], s[picked]))
        columns = ["anchor_h", "window", "vec_id", "label", "h", "score"]
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i, c in enumerate(columns)})

    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(match, kinds)


FOUND = "anchor_h long, window long, vec_id long, label long, h long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_h", "window").orderBy(F.desc("score"), "vec_id", "label", "h")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest allowed scores; equal ones by position."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _reach(norm2, need) -> F.Column:
    """Whether a row of squared length ``norm2`` may score ``need``; doubles with a margin above their rounding."""
    return (need <= 0) | (F.sqrt(F.col("norm2").cast("double")) * F.sqrt(norm2.cast("double")) * (1 + 1e-9) + 1 >= need.cast("double"))


def _wave(anchors: DataFrame, rows: DataFrame, blocks: DataFrame, groups: list[str], parts: int, found) -> DataFrame:
    """Send anchors (with ``need``, their least useful score) to the blocks of the buckets that can reach it.

    ``groups`` is ["label"] where anchors meet only rows of their own label; ``blocks`` has the blocks
    and the longest row of each bucket (and label).
    """
    keys = [*groups, "bucket", "sub", "part"]
    if groups:
        sent = anchors.join(blocks, groups)
    else:
        sent = anchors.join(F.broadcast(blocks), F.lit(True))  # a row for each bucket, BUCKETS at most
    sent = sent.where(_reach(F.col("longest"), F.col("need"))).drop("longest")
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("sub")).drop("blocks")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(parts)).cast("int"))
    live = sent.select(*groups, "bucket").distinct()
    dealt = rows.join(blocks.select(*groups, "bucket", "blocks"), [*groups, "bucket"]).join(live, [*groups, "bucket"], "left_semi")
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.select("vec_id", "label", "q", "h", "bucket", "sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return _meet(sent, dealt, keys, found, FOUND)


def _blocks(rows: DataFrame, groups: list[str], size: int) -> DataFrame:
    n = F.ceil(F.count("*") / size).cast("int").alias("blocks")
    return rows.groupBy(*groups, "bucket").agg(n, F.max("norm2").alias("longest"))


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK, buckets: int = BUCKETS, **prepare) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; see the contract in the tests.

    For every anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best
    rows of other labels whose score is ``least`` to ``most`` percent of the positive's.
    """
    tables = Tables(vectors.sparkSession)
    rows = bucketed(rows_of(vectors, **prepare), tables, buckets)
    anchors = tables.write(rows.where("anchor").select("vec_id", "label", "q", "norm2", "h"))
    stats = rows.agg(F.count_if("anchor").alias("n"), F.max("bucket").alias("last")).head()
    parts, last = max(1, -(-stats["n"] // block)), stats["last"] or 0
    first_wave = [F.col("bucket") < max(1, int((last + 1) * FIRST)), F.col("bucket") >= max(1, int((last + 1) * FIRST))]

    def same(scores, anchor, ids, labels):
        return [(0, _first(scores, (ids != anchor.vec_id) & (labels == anchor.label), positives))]

    by_label = tables.write(_blocks(rows, ["label"], block))
    got = tables.write(_best(_wave(anchors.withColumn("need", F.lit(0).cast("long")), rows, by_label.where(first_wave[0]), ["label"], parts, same), positives))
    if last:
        running = got.groupBy("anchor_h").agg(F.when(F.count("*") == positives, F.min("score")).alias("need"))
        waiting = anchors.join(running.withColumnRenamed("anchor_h", "h"), "h", "left").withColumn("need", F.coalesce("need", F.lit(0)))
        more = _wave(waiting, rows, by_label.where(first_wave[1]), ["label"], parts, same)
        got = tables.write(_best(got.drop("rank").unionByName(more), positives))

    # A positive's window in whole numbers: 50 p <= 100 s <= 95 p has no s for a negative p.
    whole = lambda c, up: F.expr(f"(cast(score as decimal(38, 0)) * {c} + {99 if up else 0}) div 100")
    window = F.struct(F.col("rank").cast("long").alias("window"), whole(least, True).alias("low"), whole(most, False).alias("high"))
    asked = got.where("score >= 0").withColumn("w", window).where("w.low <= w.high").groupBy(F.col("anchor_h").alias("h")).agg(F.sort_array(F.collect_list("w")).alias("windows"))
    seeking = tables.write(anchors.join(asked, "h"))

    def other(scores, anchor, ids, labels):
        apart = labels != anchor.label
        out = []
        for w in anchor.windows:
            at = _first(scores, apart & (scores >= w["low"]) & (scores <= w["high"]), negatives)
            out.append((w["window"], at))
        return out

    by_bucket = tables.write(_blocks(rows, [], block))
    lowest = F.array_min(F.transform("windows", lambda w: w["low"]))
    won = tables.write(_best(_wave(seeking.withColumn("need", lowest), rows, by_bucket.where(first_wave[0]), [], parts, other), negatives))
    if last:
        kth = won.groupBy("anchor_h", "window").agg(F.when(F.count("*") == negatives, F.min("score")).alias("kth"))
        kth = kth.groupBy(F.col("anchor_h").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kths"))
        need = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], F.try_element_at(F.col("kths"), w["window"]))))
        waiting = seeking.join(kth, "h", "left").withColumn("need", need).drop("kths")
        more = _wave(waiting, rows, by_bucket.where(first_wave[1]), [], parts, other)
        won = _best(won.drop("rank").unionByName(more), negatives)

    chosen = got.select("anchor_h", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = won.join(chosen, ["anchor_h", "window"]).join(anchors.select(F.col("h").alias("anchor_h"), F.col("vec_id").alias("anchor_id")), "anchor_h")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same in DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same AND anchor_id <> id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
