"""Settings of all operators: frozen values, overridable from the environment or by ``replace``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def _typed(kind: str, raw: str):
    if "bool" in kind:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if "int" in kind:
        return None if "None" in kind and raw.strip().lower() in ("none", "all", "0") else int(raw)
    return float(raw) if "float" in kind else raw.strip()


class FromEnv:
    """``from_env(prefix)``: the defaults, with PREFIX_FIELD variables (blank ones don't count) in their place."""

    @classmethod
    def from_env(cls, prefix: str = "RAGWEAVE"):
        found = {f.name: os.environ.get(f"{prefix}_{f.name}".upper(), "") for f in fields(cls)}
        return cls(**{f.name: _typed(str(f.type), found[f.name]) for f in fields(cls) if found[f.name].strip()})


@dataclass(frozen=True)
class IngestConfig(FromEnv):
    split: str = "validation"
    examples_per_language: int | None = 50
    include_english: bool = True
    include_translated: bool = True
    dedupe: bool = False
    dedupe_scope: str = "global"
    skip_empty_queries: bool = True
    drop_empty_answers: bool = False

    def __post_init__(self):
        if self.split not in ("train", "validation"):
            raise ValueError("split is train or validation")
        if self.dedupe_scope not in ("global", "per_lang"):
            raise ValueError("dedupe_scope is global or per_lang")
        if not (self.include_english or self.include_translated):
            raise ValueError("english and translated passages can't both be left out")


@dataclass(frozen=True)
class ChunkConfig(FromEnv):
    target_chars: int = 420
    min_chars: int = 80
    max_chars: int = 900
    target_sentences: int = 3
    min_sentences: int = 1
    max_sentences: int = 6
    overlap: int = 1
    window: int = 4
    window_overlap: int = 2
    similarity: float = 0.42
    dimensions: int = 256
    ngram_low: int = 3
    ngram_high: int = 5
    short_chars: int = 160
    short_sentences: int = 1
    long_chars: int = 520
    long_sentences: int = 6
    shift_sentences: int = 3
    shift_share: float = 0.25


@dataclass(frozen=True)
class RetrievalConfig(FromEnv):
    rrf_k: int = 60
    candidate_k: int = 20
    top_k: int = 10
    k1: float = 1.5
    b: float = 0.75
    idf_floor: float = 0.25
    metric: str = "cosine"


@dataclass(frozen=True)
class RoutingConfig(FromEnv):
    fast_max_tokens: int = 12
    fast_max_chars: int = 90
    deep_min_tokens: int = 22
    deep_min_clauses: int = 3
    deep_multi_part_tokens: int = 14
    ambiguity_min_tokens: int = 6
    strict_overlap: float = 0.18


@dataclass(frozen=True)
class RerankPolicy(FromEnv):
    min_top: float = 0.028
    min_gap: float = 0.006
    strong: float = 0.018
    max_strong: int = 2
    deep_skip: float = 0.040
    allow_fast: bool = False


@dataclass(frozen=True)
class AnswerConfig(FromEnv):
    max_evidence: int = 5
    max_evidence_chars: int = 3500
    duplicate_jaccard: float = 0.85
    min_score: float = 0.012
    min_query_overlap: float = 0.04
    verify_overlap: float = 0.12
    regenerate: bool = True
    retries: int = 2


#: Route -> (top_k, candidate_k, rerank, rerank_top_n, strict).
ROUTES = {"FAST": (8, 16, False, 0, False), "ACCURATE": (10, 20, True, 12, False), "DEEP": (10, 40, True, 12, True)}
