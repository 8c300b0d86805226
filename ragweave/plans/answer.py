"""The whole question answering dataflow as one lazy plan over a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.config import AnswerConfig, RerankPolicy, RetrievalConfig, RoutingConfig
from ragweave.functions import text as X
from ragweave.functions.session import settled, stable_unions
from ragweave.operators import generation, guardrails, ranking, routing


@dataclass(frozen=True)
class Answering:
    """What the plan is made of; each part can be put in from outside.

    ``retrieve(questions, k)`` returns ranked lists by name (query_id, doc_id, score, rank).
    """

    docs: DataFrame
    retrieve: Callable[[DataFrame, int], list[tuple[str, DataFrame]]]
    generate: Callable[[DataFrame, bool], DataFrame] = generation.extractive
    rerank: Callable[[DataFrame, object], DataFrame] = ranking.rerank_lexical
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    routes: RoutingConfig = field(default_factory=RoutingConfig)
    policy: RerankPolicy = field(default_factory=RerankPolicy)
    answers: AnswerConfig = field(default_factory=AnswerConfig)
    #: What ``run`` keeps between the branches of its plan, until ``release``.
    kept: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return self.kept[-1]

    def release(self) -> None:
        """Give up what was kept, once the responses have been written."""
        while self.kept:
            self.kept.pop().unpersist()

    def hits(self, asked: DataFrame) -> DataFrame:
        """Fused hits of routed questions, with query, document text and language."""
        lists = self.retrieve(asked, int(max(p[1] for p in ranking.ROUTES.values())))
        depth = asked.select("query_id", "candidate_k", "top_k")
        cut = [(name, ranking.beside(df, depth, "query_id").where(F.col("rank") <= F.col("candidate_k")).drop("candidate_k", "top_k")) for name, df in lists]
        fused = ranking.fuse(cut, self.retrieval.rrf_k, F.lit(1 << 30))
        fused = settled(ranking.beside(fused, depth, "query_id").where(F.col("rank") <= F.col("top_k")))  # top_k rows a question
        texts = self.docs.select("doc_id", "text", "language")
        named = asked.select("query_id", F.col("text").alias("query"), "rerank_top_n")
        return ranking.beside(ranking.beside(texts, fused, "doc_id"), named, "query_id", text="query").withColumn("score", F.col("rrf"))

    def run(self, questions: DataFrame) -> DataFrame:
        """One response per question (query_id, text): status, answer, sources, route and how it came about."""
        spark = questions.sparkSession
        stable_unions(spark)
        blank = questions.where(X.squeeze_ends(F.coalesce("text", F.lit(""))) == "")
        asked = routing.features(questions.where(X.squeeze_ends(F.coalesce("text", F.lit(""))) != ""), self.routes)
        asked = asked.join(F.broadcast(ranking.route_plans(spark)), "route")  # three rows
        hits = self._keep(self.hits(asked))  # top_k rows a question, read by five branches
        decided = ranking.decisions(asked.join(ranking.signals(hits, self.policy), "query_id", "left"), self.policy)
        flag = decided.select("query_id", "applied")
        marked = hits.join(flag, "query_id")
        # Only the hits to rescore reach the reranker.
        again = self.rerank(marked.where("applied"), F.col("rerank_top_n")).withColumn("score", F.col("rerank_score")).drop("rerank_score")
        final = marked.where("not applied").unionByName(again)
        final = self._keep(final)
        gated = guardrails.gate(decided, final, self.answers)
        packed = guardrails.evidence(final, self.answers)
        ready = self._keep(gated.join(packed, "query_id", "left").withColumn("strict_overlap", F.when(F.col("strict"), F.lit(self.routes.strict_overlap))))
        open_ = ready.where(F.col("sufficient") & (F.size("items") > 0))
        first = self._answered(open_, False)
        good = first.where("verified or status != 'grounded'")
        if self.answers.regenerate:
            back = [c for c in first.columns if c in open_.columns]
            good = good.unionByName(self._answered(first.where("not verified and status = 'grounded'").select(*back), True))
        else:
            good = first
        closed = ready.where(~(F.col("sufficient") & (F.coalesce(F.size("items"), F.lit(0)) > 0)))
        return self._responses(good, closed, blank)

    def _answered(self, df: DataFrame, strict: bool) -> DataFrame:
        raw = self.generate(df, strict)
        raw = raw.select(*df.columns, F.inline(F.array(guardrails.parsed(F.col("raw")))))
        return guardrails.grounded(raw, self.answers)

    def _responses(self, good: DataFrame, closed: DataFrame, blank: DataFrame) -> DataFrame:
        ok = (F.col("status") == "grounded") & F.col("verified")
        ids = F.transform("items", lambda k: k["doc_id"].cast("string"))
        cited = F.array_intersect(ids, "sources")
        why = F.when(ok, F.lit(None).cast("string")).when(F.col("status") == "llm_error", "llm_error").when(F.col("status") == "grounded", "unsupported_claims")
        none = F.array().cast("array<string>")
        said = good.select(
            "query_id", F.when(ok, "grounded").otherwise("insufficient_context").alias("status"), F.when(ok | (F.col("status") == "insufficient_context"), F.col("answer")).otherwise(guardrails.refusal(F.col("language"))).alias("answer"),
            F.when(ok, F.when(F.size(cited) > 0, cited).otherwise(ids)).otherwise(none).alias("sources"), "route", F.col("applied").alias("reranked"), F.col("reason").alias("rerank_reason"), why.alias("grounding_reason"), "confidence",
        )
        reason = F.when(~F.col("sufficient"), F.col("gate_reason")).otherwise("no_evidence")
        refused = closed.select("query_id", F.lit("insufficient_context").alias("status"), guardrails.refusal(F.col("language")).alias("answer"), none.alias("sources"), "route", F.col("applied").alias("reranked"), F.col("reason").alias("rerank_reason"), reason.alias("grounding_reason"), F.lit(0.0).alias("confidence"))
        empty = blank.select("query_id", F.lit("invalid_query").alias("status"), guardrails.refusal(F.lit("en")).alias("answer"), none.alias("sources"), F.lit(None).cast("string").alias("route"), F.lit(False).alias("reranked"), F.lit(None).cast("string").alias("rerank_reason"), F.lit(None).cast("string").alias("grounding_reason"), F.lit(0.0).alias("confidence"))
        return said.unionByName(refused).unionByName(empty)
