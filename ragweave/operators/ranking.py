"""Ranking operators: lexical and dense top-k, rank fusion, rerank policy, lexical reranking."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.config import ROUTES, RerankPolicy, RetrievalConfig
from ragweave.functions import text as X

log = logging.getLogger(__name__)
#: A query side is broadcast while it has at most so many rows; beyond, both sides are shuffled.
BROADCAST_QUERIES = 100_000
#: Characters of texts that are broadcast with it.
BROADCAST_CHARS = 64_000_000
SCORE_DIGITS = 6
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Why a question is reranked or not, which callers match on.
REASONS = {
    "fast": "route_fast", "sure": "hybrid confidence was sufficient", "unasked": "route_does_not_request",
    "deep": "DEEP and hybrid ranking is not uniquely strong", "unsure": "hybrid ranking is ambiguous",
}


def _small(df: DataFrame, rows: int = BROADCAST_QUERIES) -> bool:
    """Whether ``df`` may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def few_texts(df: DataFrame, text: str) -> bool:
    """Whether ``df`` with its column ``text`` may be broadcast."""
    found = df.limit(BROADCAST_QUERIES + 1).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).head()
    return found["n"] <= BROADCAST_QUERIES and (found["chars"] or 0) <= BROADCAST_CHARS


def beside(left: DataFrame, small: DataFrame, on, how: str = "inner", text: str | None = None) -> DataFrame:
    """Join with a side that is usually small: it is broadcast if its rows, and the characters of its column ``text``, are within the bounds."""
    few = few_texts(small, text) if text else _small(small)
    return left.join(F.broadcast(small) if few else small, on, how)


def top_k(scored: DataFrame, k: int | Column, key: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The first ``k`` rows of each key by falling score, with their rank; equal scores by ``tie``.

    The condition is pushed below the shuffle as a limit per group.
    """
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class LexicalIndex:
    """Okapi BM25 over documents (doc_id, text, any more columns): postings, lengths and term weights.

    Nothing is materialised here: the parts are plans, and ``write`` and ``read`` keep them as tables.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame, config: RetrievalConfig):
        self.postings, self.terms, self.config = postings, terms, config

    @classmethod
    def build(cls, docs: DataFrame, config: RetrievalConfig | None = None) -> LexicalIndex:
        cfg = config or RetrievalConfig()
        kept = docs.where(X.squeeze_ends(F.coalesce("text", F.lit(""))) != "")
        sorted_ = F.sort_array(X.tokens(F.col("text")))
        kept = kept.select("doc_id", F.inline(F.array(F.struct(sorted_.alias("t")))))
        # The runs of the sorted tokens are the document's terms: nothing is shuffled to count them.
        starts = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get(F.col("t"), i - 1)), i)), lambda i: i.isNotNull())
        kept = kept.select("*", F.inline(F.array(F.struct(starts.alias("at")))))
        n = F.size("t")
        run = F.transform("at", lambda i, k: F.struct(F.get(F.col("t"), i).alias("term"), (F.coalesce(F.get(F.col("at"), k + 1), n) - i).cast("long").alias("tf")))
        postings = kept.select("doc_id", n.alias("length"), F.inline(run))
        # One scan gives document frequencies and, under a null term, the number of documents and their length.
        seen = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), n.cast("long").alias("length"))), F.transform("at", lambda i: F.struct(F.get(F.col("t"), i).alias("term"), F.lit(0).cast("long").alias("length"))))
        found = kept.select(F.inline(seen)).groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("total"))
        corpus = found.where("term is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avg_length"))  # one row
        raw = found.where("term is not null").join(F.broadcast(corpus), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean_raw"))  # one row, as corpus
        idf = F.when(F.col("raw") < 0, F.lit(cfg.idf_floor) * F.col("mean_raw")).otherwise(F.col("raw"))
        terms = raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", "avg_length", idf.alias("idf"))
        return cls(postings, terms, cfg)

    def write(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def read(cls, spark, path: str, config: RetrievalConfig | None = None) -> LexicalIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), config or RetrievalConfig())

    def search(self, queries: DataFrame, k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score and rank of the best positive scores of each query (query_id, text).

        ``allowed`` (doc_id) filters after weighting, so term weights stay those of the corpus.
        """
        cfg = self.config
        asked = queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        small = _small(asked)
        weighted = self.terms.join(F.broadcast(asked) if small else asked, "term")  # a row for each of asked at most
        norm = F.lit(1 - cfg.b) + F.lit(cfg.b) * F.col("length") / F.col("avg_length")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + F.lit(cfg.k1) * norm)
        hits = self.postings.join(F.broadcast(weighted) if small else weighted, "term")
        if allowed is not None:
            hits = hits.join(allowed.select("doc_id"), "doc_id", "left_semi")
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score")).where("score > 0")
        return top_k(scored, k or cfg.top_k)


def vector_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of all rows of both: cosine, dot or euclid (negated distance)."""
    if metric == "dot":
        return left @ right.T
    if metric == "cosine":
        norm = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
        return norm(left) @ norm(right).T
    if metric in ("euclid", "euclidean"):
        return -np.sqrt(np.maximum((left**2).sum(1)[:, None] + (right**2).sum(1)[None] - 2 * left @ right.T, 0))
    raise ValueError(f"unknown metric {metric!r}")


def sound(df: DataFrame) -> DataFrame:
    """Rows whose vector is there and whole, with ``size``."""
    return df.where("embedding is not null").where(~F.exists("embedding", lambda x: x.isNull())).withColumn("size", F.size("embedding"))


def slab(docs: int) -> int:
    """Queries of a block that are scored at once with so many documents."""
    return max(1, CELLS // max(docs, 1))


def meet(rows: DataFrame, asked: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """query_id, doc_id and score of the best ``k`` of each block of ``rows`` for each query of the block of ``asked`` with its keys.

    A task holds two blocks and their product, so both sides' keys must bound their blocks.
    """
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        ids, docs = left["query_id"].to_numpy(), right["doc_id"].to_numpy()
        matrices = [np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (left, right)]
        n, step, parts = min(k, len(docs)), slab(len(docs)), []
        for at in range(0, len(ids), step):
            scores = np.round(vector_scores(matrices[0][at : at + step], matrices[1], metric), SCORE_DIGITS)
            least = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
            q, d = np.nonzero(scores >= least)
            parts.append(pd.DataFrame({"query_id": ids[at + q], "doc_id": docs[d], "score": scores[q, d]}))
        found = pd.concat(parts).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    left = asked.select("query_id", "embedding", *keys).groupBy(*keys)
    return left.cogroup(rows.select("doc_id", "embedding", *keys).groupBy(*keys)).applyInPandas(best, kinds)


def dealt(df: DataFrame, column: str, key: str, blocks: int) -> DataFrame:
    """Add ``column``: one of ``blocks`` blocks, by a hash of the row's id and vector."""
    return df.withColumn(column, F.pmod(F.xxhash64(key, "embedding"), F.lit(blocks)).cast("int"))


def copied(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """Each row once for each of ``blocks`` blocks."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(column))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where: Column | None = None, block: int = 16_384) -> DataFrame:
    """query_id, doc_id, score and rank of the most similar vectors (doc_id, embedding) of each query: the exact scan.

    Blocks of queries meet blocks of vectors, some ``block`` rows each, in one matrix product that
    keeps its best ``k``; no vector goes to the driver. ``where`` filters the vectors beforehand. Null
    vectors, vectors with a null number and vectors of another size than a query's don't meet it.
    """
    vector_scores(np.ones((1, 1)), np.ones((1, 1)), metric)
    rows = sound((vectors.where(where) if where is not None else vectors).select("doc_id", "embedding"))
    asked = sound(queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding")))  # may come of the vectors
    n, m = (max(1, -(-df.count() // block)) for df in (rows, asked))
    rows = copied(dealt(rows, "vb", "doc_id", n), "qb", m)
    asked = copied(dealt(asked, "qb", "query_id", m), "vb", n)
    return top_k(meet(rows, asked, ["size", "vb", "qb"], k, metric), k)


def fuse(lists: list[tuple[str, DataFrame]], k: int = 60, limit: int | Column = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, score, rank).

    Returns query_id, doc_id, rrf, {name}_score and rank. Of equal sums the document seen first, in
    the order of ``lists`` and ranks, comes first. A blank document id uses its rank up and goes.
    """
    every = None
    for n, (name, df) in enumerate(lists):
        part = df.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "rank", F.lit(n).alias("list"), F.lit(name).alias("name"))
        every = part if every is None else every.unionByName(part)
    every = every.where(F.col("doc_id").isNotNull() & (F.btrim(F.col("doc_id").cast("string")) != ""))
    fused = every.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"),
        F.min(F.struct("list", "rank")).alias("seen"),
        *(F.max(F.when(F.col("name") == name, F.col("score"))).alias(f"{name}_score") for name, _ in lists),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seen")


def signals(hits: DataFrame, policy: RerankPolicy | None = None) -> DataFrame:
    """query_id, top, gap and n_strong of fused hits."""
    cfg = policy or RerankPolicy()
    scores = F.sort_array(F.collect_list("rrf"), asc=False)
    got = hits.groupBy("query_id").agg(scores.alias("s"))
    return got.select(
        "query_id", F.get("s", F.lit(0)).alias("top"), (F.get("s", F.lit(0)) - F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))).alias("gap"),
        F.size(F.filter("s", lambda x: x >= cfg.strong)).alias("n_strong"),
    )


def confident(policy: RerankPolicy) -> Column:
    near = (F.col("gap") < policy.min_gap) & (F.col("n_strong") > 1)
    return (F.col("top") >= policy.min_top) & ~near & (F.col("n_strong") <= policy.max_strong)


def decisions(found: DataFrame, policy: RerankPolicy | None = None) -> DataFrame:
    """Add requested, applied and reason to rows with route, top, gap and n_strong (nulls: no hits)."""
    cfg = policy or RerankPolicy()
    df = found.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("top", "gap", "n_strong")})
    fast = (F.col("route") == "FAST") & F.lit(not cfg.allow_fast)
    deep = F.col("route") == "DEEP"
    very = (F.col("top") >= cfg.deep_skip) & ((F.col("gap") >= cfg.min_gap) | (F.col("n_strong") <= 1))
    sure = confident(cfg)
    wants = F.col("route") != "FAST"
    skipped = F.when(fast, REASONS["fast"]).when(deep & very, REASONS["sure"]).when(~deep & sure, REASONS["sure"]).when(~deep & ~wants, REASONS["unasked"])
    reason = F.when(deep, REASONS["deep"]).otherwise(REASONS["unsure"])
    return df.withColumns({"requested": F.when(fast, F.lit(False)).when(deep, F.lit(True)).otherwise(wants), "applied": skipped.isNull(), "reason": F.coalesce(skipped, reason)})


def rerank_lexical(hits: DataFrame, top_n: int | Column) -> DataFrame:
    """Rescore the first ``top_n`` hits (query, text, rrf, rank) by the share of query tokens they have.

    Returns their columns with rerank_score and the new rank; equal scores keep their order.
    """
    kept = hits.where(F.col("rank") <= F.greatest(F.lit(top_n) if isinstance(top_n, int) else top_n, F.lit(1)))
    scored = kept.withColumn("rerank_score", F.round(X.coverage(F.array_distinct(X.tokens(F.col("query"))), X.tokens(F.col("text"))), SCORE_DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order))


def rerank_model(hits: DataFrame, top_n: int | Column, score) -> DataFrame:
    """As ``rerank_lexical`` with a pandas UDF ``score(query, text)``; only the rows to rescore reach it."""
    kept = hits.where(F.col("rank") <= F.greatest(F.lit(top_n) if isinstance(top_n, int) else top_n, F.lit(1)))
    scored = kept.withColumn("rerank_score", score("query", "text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order))


def reranker(kind: str = "auto", load: Callable[[], Callable] | None = None) -> tuple[str, Callable[[DataFrame, object], DataFrame]]:
    """The reranker that was chosen, "model" or "lexical", and its function of hits and how many to rescore.

    ``load()`` gives the model's pandas UDF ``score(query, text)``. "model" raises its errors; "auto" takes the
    model if it loads and the lexical reranker if there is none or it doesn't.
    """
    if kind not in ("auto", "model", "lexical"):
        raise ValueError("a reranker is auto, model or lexical")
    if kind == "model" and load is None:
        raise ValueError("there is no model to load")
    if kind == "lexical" or load is None:
        return "lexical", rerank_lexical
    try:
        score = load()
    except Exception as e:  # whatever keeps a model from loading
        if kind == "model":
            raise
        log.warning("the reranking model was not loaded, hits are reranked lexically: %s", e)
        return "lexical", rerank_lexical
    return "model", lambda hits, top_n: rerank_model(hits, top_n, score)


def route_plans(spark) -> DataFrame:
    """route, top_k, candidate_k, rerank, rerank_top_n and strict: one row per route."""
    return spark.createDataFrame([(r, *v) for r, v in ROUTES.items()], "route string, top_k int, candidate_k int, rerank boolean, rerank_top_n int, strict boolean")
