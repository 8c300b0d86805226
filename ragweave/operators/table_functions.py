"""The chunkers as a SQL table function: ``SELECT … FROM passages p, LATERAL chunk(p.text, 'semantic')``.

Plans over DataFrames use ``chunking.chunks``, which keeps all but the sentence vectors in the JVM. This is the
same cut for SQL users: each row's text goes to Python by Arrow and its chunks come back beside the row,
without a shuffle. Null and blank texts give no rows (Spark 4.1 gives none for them with LEFT JOIN LATERAL
either); an unknown strategy fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ragweave.config import ChunkConfig
from ragweave.functions import text as X
from ragweave.functions.session import ship
from ragweave.operators.chunking import STRATEGIES, HashedNgrams, next_to

COLUMNS = "chunk_index int, start_sentence int, end_sentence int, text string, char_length int, sentence_count int, adaptive_reason string"
#: The marks of ``SENTENCE_END`` before white space, which leaves out the four separators of BLANKS.
_END = re.compile("(?<=[.!?।؟۔…])[" + re.sub("[\x1c-\x1f]", "", X.BLANKS) + "]+")
Span = tuple[int, int]


def sentences(text: str) -> list[str]:
    parts = (s.strip(X.BLANKS) for s in _END.split(text.strip(X.BLANKS)))
    return [s for s in parts if s]


def slid(n: int, cfg: ChunkConfig) -> Iterator[Span]:
    width = max(1, cfg.window)
    stride = max(1, width - max(0, min(cfg.window_overlap, width - 1)))
    for k in range(max(0, -(-(n - width) // stride)) + 1 if n else 0):
        yield k * stride, min(n - 1, k * stride + width - 1)


def walked(sizes: list[int], at: int, last: int, cfg: ChunkConfig) -> Iterator[Span]:
    """Spans from sentence ``at`` to ``last``, each as long as its joined text fits."""
    reach, back = min(cfg.target_sentences, cfg.max_sentences), max(0, min(cfg.overlap, cfg.target_sentences - 1))
    while at <= last:
        end, total = at, sizes[at]
        for k in range(1, min(reach, last - at + 1)):
            total += 1 + sizes[at + k]
            if total > (cfg.max_chars if k < cfg.min_sentences else min(cfg.target_chars, cfg.max_chars)):
                break
            end = at + k
        yield at, end
        at = last + 1 if end >= last else max(end - back + 1, at + 1) if back else end + 1


def by_topic(sizes: list[int], near: np.ndarray, cfg: ChunkConfig) -> Iterator[Span]:
    """Spans between sentences that are unlike: small ones join the one before, large ones are walked."""
    if not sizes:
        return
    chars = lambda a, b: sum(sizes[a : b + 1]) + b - a
    cuts = [0, *(int(i) + 1 for i in np.flatnonzero(near < cfg.similarity)), len(sizes)]
    merged: list[Span] = []
    for a, b in zip(cuts, (c - 1 for c in cuts[1:]), strict=False):
        if merged and (b - a + 1 < cfg.min_sentences or chars(a, b) < cfg.min_chars):
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    for a, b in merged:
        if b - a + 1 <= cfg.max_sentences and chars(a, b) <= cfg.max_chars:
            yield a, b
        else:
            yield from walked(sizes, a, b, cfg)


def spans(parts: list[str], strategy: str, cfg: ChunkConfig, embed: Callable[[list[str]], np.ndarray]) -> tuple[Iterator[Span], str | None]:
    """The spans of a text's sentences, and why the adaptive strategy chose them."""
    sizes, n = [len(s) for s in parts], len(parts)
    near = lambda: next_to(np.asarray(embed(parts))) if parts else np.zeros(0)
    if strategy == "sliding":
        return slid(n, cfg), None
    if strategy == "structure":
        return walked(sizes, 0, n - 1, cfg), None
    if strategy == "semantic":
        return by_topic(sizes, near(), cfg), None
    chars = sum(sizes) + max(n - 1, 0)
    if n <= cfg.short_sentences or chars <= cfg.short_chars:
        return walked(sizes, 0, n - 1, cfg), "structure:short_passage" if n else "structure:empty"
    if n >= cfg.long_sentences or chars >= cfg.long_chars:
        return slid(n, cfg), "sliding:long_passage"
    if n >= cfg.shift_sentences:
        found = near()
        low = int((found < cfg.similarity).sum())
        if low and low / len(found) >= cfg.shift_share:
            return by_topic(sizes, found, cfg), "semantic:topic_shift"
    return walked(sizes, 0, n - 1, cfg), "structure:typical_multi_sentence"


def register(spark: SparkSession, name: str = "chunk", cfg: ChunkConfig | None = None, embed=None) -> None:
    """Register ``name(text, strategy)`` in this session; ``embed`` is as that of ``chunking.chunks``."""
    ship(spark)
    cfg = cfg or ChunkConfig()
    embed = embed or HashedNgrams(cfg)

    class Chunk:
        def eval(self, text: str, strategy: str):
            if strategy not in STRATEGIES:
                raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
            parts = sentences(text or "")
            found, why = spans(parts, strategy, cfg, embed)
            for i, (a, b) in enumerate(found):
                chunk = " ".join(parts[a : b + 1])
                yield i, a, b, chunk, len(chunk), b - a + 1, why

    spark.udtf.register(name, F.udtf(Chunk, returnType=COLUMNS, useArrow=True))
