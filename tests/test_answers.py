"""The answer plan by value: what is answered, refused and why, with the generators put in."""

import json
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragweave.operators import generation, guardrails, ranking
from ragweave.plans.answer import Answering

DOCS = [
    (1, "The capital of France is Paris. It lies on the river Seine.", "en"), (2, "A corporation is a legal entity. It exists by law.", "en"), (3, "Mountains are high places with snow.", "en"),
    (4, "Rivers carry water to the sea.", "en"), (5, "Bees make honey in summer.", "en"), (6, "Trains run on rails of steel.", "en"),
]
ASKED = [(1, "What is the capital of France?"), (2, "zzz qqq xxx"), (3, "  "), (4, None), (5, "What is a corporation?")]


def responses(spark, **parts):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, language string")
    index = ranking.LexicalIndex.build(docs)
    plan = Answering(docs, lambda q, k: [("bm25", index.search(q, k))], **parts)
    got = {r["query_id"]: r for r in plan.run(spark.createDataFrame(ASKED, "query_id long, text string")).collect()}
    assert len(plan.kept) == 3
    plan.release()
    assert not plan.kept
    return got


def test_quoted_answers(spark):
    got = responses(spark)
    assert len(got) == 5
    assert (got[1]["status"], got[1]["answer"], got[1]["sources"], got[1]["route"]) == ("grounded", "The capital of France is Paris.", ["1"], "FAST")
    assert got[5]["answer"] == "A corporation is a legal entity." and got[5]["confidence"] == 1.0 and not got[5]["reranked"] and got[5]["rerank_reason"] == "route_fast"
    assert (got[2]["status"], got[2]["grounding_reason"], got[2]["answer"]) == ("insufficient_context", "no_hits", guardrails.REFUSAL["en"])
    assert all((got[i]["status"], got[i]["sources"]) == ("invalid_query", []) for i in (3, 4))


@pytest.mark.parametrize(
    ("kind", "status", "reason"),
    [("good", "grounded", None), ("fenced", "grounded", None), ("second", "grounded", None), ("invented", "insufficient_context", "unsupported_claims"), ("broken", "insufficient_context", "llm_error"), ("raises", "insufficient_context", "llm_error"), ("refuses", "insufficient_context", None)],
)
def test_injected_generators(spark, kind, status, reason):
    """A client's answer is parsed, checked against the evidence, asked for again strictly, or refused."""
    good = json.dumps({"answer": "The capital of France is Paris.", "status": "grounded", "sources": [{"chunk_id": "1"}]})
    invented = json.dumps({"answer": "Purple elephants invented television yesterday.", "sources": []})

    def complete(system, prompt):
        assert "Question: " in prompt and "Source 1 (document " in prompt
        if kind == "raises":
            raise TimeoutError
        said = {"good": good, "fenced": f"Sure:\n```json\n{good}\n```", "invented": invented, "broken": "no json", "refuses": '{"answer": "Not in the sources.", "status": "INSUFFICIENT_CONTEXT"}'}
        return (good if system == "quote only" else invented) if kind == "second" else said[kind]

    got = responses(spark, generate=generation.injected(complete, "answer", "quote only", retries=1))[1]
    assert (got["status"], got["grounding_reason"]) == (status, reason)
    if status == "grounded":
        assert got["answer"] == "The capital of France is Paris." and got["sources"] == ["1"]
    if kind == "refuses":
        assert got["answer"] == "Not in the sources."


def test_rerank_model(spark):
    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype("float64")

    hits = spark.createDataFrame([(1, "q", "aa", 0.3, 1), (1, "q", "a", 0.2, 2), (1, "q", "aaaa", 0.1, 3), (2, "q", "bb", 0.3, 1), (2, "q", "cc", 0.2, 2)], "query_id long, query string, text string, rrf double, rank int")
    got = [(r["query_id"], r["text"], r["rank"]) for r in ranking.rerank_model(hits, 2, score).orderBy("query_id", "rank").collect()]
    assert got == [(1, "aa", 1), (1, "a", 2), (2, "bb", 1), (2, "cc", 2)]
    assert [r["text"] for r in ranking.rerank_model(hits.where("query_id = 1"), 3, score).orderBy("rank").collect()] == ["aaaa", "aa", "a"]


def asked_frame(spark, n=24):
    items = [{"doc_id": 1, "text": "Paris is the capital.", "language": "en", "score": 0.5}]
    rows = [(i, f"question {i % 12}", "en", items) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, text string, language string, items array<struct<doc_id:long,text:string,language:string,score:double>>")


def test_kept_answers(spark, tmp_path):
    """Each distinct prompt is asked once, several at a time; a rerun asks only what failed."""
    calls, path = tmp_path / "calls", f"file://{tmp_path}/responses"
    calls.mkdir()
    good = json.dumps({"answer": "Paris", "status": "grounded", "sources": []})

    def client(broken):
        def complete(system, prompt):
            (calls / uuid.uuid4().hex).write_text(prompt)
            time.sleep(0.3)
            if broken and "question 3" in prompt:
                raise TimeoutError
            return "nothing" if broken and "question 4" in prompt else good

        return complete

    ask = lambda broken, **more: {r["query_id"]: r for r in generation.kept(client(broken), path, "answer", retries=1, tasks=1, **more)(asked_frame(spark)).collect()}
    began = time.time()
    got = ask(True, concurrency=12)
    assert time.time() - began < 0.3 * 14 + 15  # twelve at a time; one by one would add their sums
    assert len(list(calls.iterdir())) == 12 + 2  # the broken ones are tried again
    assert len(got) == 24 and [got[i]["error"] for i in (0, 3, 15, 4, 16)] == [None, "timeout", "timeout", "invalid_json", "invalid_json"]
    assert got[0]["raw"] == got[12]["raw"] == good and got[3]["raw"] is None and (got[3]["attempts"], got[0]["attempts"]) == (2, 1)
    got = ask(False, wave=1)  # only the two that failed
    assert len(list(calls.iterdir())) == 14 + 2 and all(r["raw"] == good and r["error"] is None for r in got.values())
    ask(True)
    assert len(list(calls.iterdir())) == 16


@pytest.mark.parametrize("e,kind", [(TimeoutError(), "timeout"), (ConnectionResetError(), "connection"), (json.JSONDecodeError("x", "y", 0), "invalid_json"), (type("RateLimitError", (Exception,), {})(), "rate_limited"), (KeyError(), "client_error")])
def test_error_kinds(e, kind):
    assert generation.error_kind(e) == kind
