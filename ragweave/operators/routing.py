"""Query features and routes, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.config import RoutingConfig
from ragweave.functions import text as X

#: The words and patterns that a feature looks for, in any case.
COMPARISON = r"\b(compare|comparison|versus|vs\.?|differ|difference|differences|better|worse|trade-?off)\b"
EXPLANATION = r"\b(why|how|explain|describe|because|mechanism|process|formed|works?)\b"
FACTUAL = r"\b(what|who|when|where|which|capital|define|definition|meaning)\b"
AMBIGUITY = r"\b(or|either|maybe|possibly|unclear|depends|might|could)\b"
MULTI_PART = r"(\band then\b|\bfirst\b.+\bsecond\b|\balso\b.+\band\b|\d+\.\s|\band which\b|\band when\b)"
CLAUSES = r"[;?]|(?:\s+and\s+)|(?:\s+then\s+)|(?:\s*,\s+)"
ENTITY = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"
QUOTED = "[\"“”']([^\"“”']+)[\"“”']"


def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?iuU)" + pattern)


def features(queries: DataFrame, config: RoutingConfig | None = None) -> DataFrame:
    """Add query features, query_type, route and complexity to a table with ``text``."""
    cfg = config or RoutingConfig()
    q = F.col("q")
    asks = q.endswith("?") | q.endswith("؟")
    df = queries.withColumn("q", X.squeeze_ends(F.coalesce("text", F.lit(""))))
    parts = F.filter(F.split(q, "(?U)" + CLAUSES), lambda p: X.squeeze_ends(p) != "")
    quoted = F.filter(F.transform(F.regexp_extract_all(q, F.lit(QUOTED), F.lit(1)), X.squeeze_ends), lambda x: x != "")
    df = df.withColumns({
        "n_chars": F.length(q),
        "n_tokens": F.size(X.tokens(q)),
        "n_clauses": F.when(q == "", 0).otherwise(F.greatest(F.size(parts), F.lit(1))),
        "n_questions": F.greatest(F.regexp_count(q, F.lit("[?؟।]")), asks.cast("int")),
        "n_entities": F.size(F.array_distinct(F.concat(F.regexp_extract_all(q, F.lit("(?U)" + ENTITY), F.lit(0)), quoted))),
        "comparison": _has(q, COMPARISON),
        "explanation": _has(q, EXPLANATION),
        "factual": _has(q, FACTUAL),
        "language": X.script_language(q),
    })
    df = df.withColumns({
        "ambiguity": _has(q, AMBIGUITY) & (F.col("n_tokens") >= cfg.ambiguity_min_tokens),
        "multi_part": _has(q, MULTI_PART) | (F.col("n_questions") >= 2) | (F.col("n_clauses") >= cfg.deep_min_clauses),
    })
    kind = (
        F.when(F.col("multi_part") | (F.col("n_questions") >= 2), "multi_part").when(F.col("comparison"), "comparison")
        .when(F.col("explanation"), "explanation").when(F.col("factual") | asks, "factual").otherwise("other")
    )
    two = F.col("n_clauses") >= 2
    deep = (
        (F.col("n_clauses") >= cfg.deep_min_clauses) | (F.col("n_questions") >= 2)
        | (F.col("multi_part") & (F.col("n_tokens") >= cfg.deep_multi_part_tokens))
        | (F.col("comparison") & F.col("explanation") & two)
        | ((F.col("n_tokens") >= cfg.deep_min_tokens) & (F.col("comparison") | F.col("explanation") | F.col("ambiguity")))
        | (F.col("ambiguity") & F.col("explanation"))
    )
    accurate = F.col("explanation") | F.col("comparison") | two | (F.col("n_tokens") > cfg.fast_max_tokens) | (F.col("n_chars") > cfg.fast_max_chars) | F.col("ambiguity")
    route = F.when((q != "") & deep, "DEEP").when((q != "") & accurate, "ACCURATE").otherwise("FAST")
    df = df.withColumns({"query_type": kind, "route": route})
    complexity = F.when(F.col("route") == "DEEP", "complex").when(F.col("route") == "ACCURATE", "moderate").otherwise("simple")
    return df.withColumn("complexity", complexity).drop("q")
