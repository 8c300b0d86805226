"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table, broadcast to all workers, of frequent pre-tokens (what the
tokenizer's pattern cuts a text into) and their lengths in tokens. Tier two is a cache in each
worker: pre-tokens that miss are encoded by the library once and kept, up to ``CACHE`` entries.
Pre-tokens are never shuffled.

Frequent pre-tokens come from all texts: each task counts pre-tokens and drops the rarest when it
has too many, these summaries are merged in two levels, and the ``FREQUENT`` largest are taken. They
only decide what is looked up fast; counts are exact whatever is in the table.

Exactness: byte-level BPE never merges across pre-tokens, so a text has the sum of its pre-tokens'
counts. The pattern is applied here only to characters on whose classes (letter, digit, space)
every Unicode version agrees; a text with others is encoded by the library as a whole. Added tokens
of the tokenizer inside a text count as one token each, as the library has it.

Defined results: null is the empty text with 0 bytes and tokens; rows are independent; an empty
table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "byte_bpe_50k.json"
LIMIT = 512
FREQUENT = 8192
CACHE = 1_000_000
LONG = 200
#: The pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks whose characters all have had their class since early Unicode versions.
STABLE = "\\x00-\u0377\u0400-\u0523\u2000-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: The same pattern for texts of the characters below, whose classes ``re`` knows; it is the faster engine.
PLAIN_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
PLAIN = "\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f\u2010-\u2027"
_CUT = regex.compile(PATTERN)
_PLAIN_CUT = re.compile(PLAIN_PATTERN)
_NOT_PLAIN = re.compile(f"[^{PLAIN}]")
_OTHER = regex.compile(f"[^{STABLE}]")
#: Per process: (path, name of the table) -> Counts.
_COUNTS: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def pretokens(text: str) -> list[str]:
    """What the tokenizer's pattern cuts a text into."""
    return _CUT.findall(text) if _NOT_PLAIN.search(text) else _PLAIN_CUT.findall(text)


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if merges come in the order of their ids (so ids are merge ranks); else None."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if any(vocab.get(p) != 256 + i for i, p in enumerate(pairs)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    words = {w: i for w, i in vocab.items() if i < 256 + len(merges)}
    if len(words) != 256 + len(merges) or any(c not in byte for w in words for c in w):
        return None
    return {bytes(byte[c] for c in w): i for w, i in words.items()}


class Lengths(dict):
    """pre-token -> tokens: the frequent ones and a cache of up to CACHE others; misses are encoded."""

    def __init__(self, frequent: dict[str, int], encode):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class Counts:
    """Counts tokens of texts; ``frequent`` maps pre-tokens to lengths."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        plain = plain and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
        added = spec["added_tokens"]
        self.plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.markers = sorted((t["content"] for t in added), key=len, reverse=True)
        self.marked = re.compile("|".join(map(re.escape, self.markers))) if added else None
        self.lengths = Lengths(frequent or {}, self._encoder(spec) if self.plain else None)

    def _encoder(self, spec: dict):
        """A function giving the length of one pre-token; by ranks where they are the library's merges."""
        ranks = _byte_ranks(spec)
        if ranks is None:
            return lambda piece: len(self.library.encode(piece, add_special_tokens=False).ids)
        import tiktoken

        ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda piece: len(ordinary(piece))  # the pattern cuts a pre-token no further

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def one(self, text: str) -> int:
        if not self.plain or not (text.isascii() or not _OTHER.search(text)):
            return self.whole([text])[0]
        lengths = self.lengths
        if not any(m in text for m in self.markers):
            return sum(map(lengths.__getitem__, pretokens(text)))
        parts = self.marked.split(text)
        return len(parts) - 1 + sum(lengths[p] for part in parts for p in pretokens(part))

    def count(self, texts: list[str]) -> list[int]:
        return [self.one(t) for t in texts]


def _top(counts: Counter, n: int) -> Counter:
    return Counter(dict(heapq.nlargest(n, counts.items(), key=lambda x: (x[1], x[0]))))


def _pack(counts: Counter) -> bytes:
    return json.dumps([(p, n) for p, n in counts.items() if len(p) <= LONG]).encode()


def _unpack(data: bytes) -> Counter:
    return Counter(dict(json.loads(data)))


def frequent_pretokens(docs: DataFrame, path: str | None = None, keep: int = FREQUENT) -> list[str]:
    """About the ``keep`` most frequent pre-tokens of all texts, by bounded summaries of each task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pretokens(text))
                if len(counts) > 40 * keep:  # the smallest go; which are frequent is no matter of exactness
                    counts = _top(counts, 10 * keep)
        if counts:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "summary": pa.array([_pack(_top(counts, keep))], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for data in group.column("summary").to_pylist():
            total.update(_unpack(data))
            if len(total) > 8 * keep:
                total = _top(total, 2 * keep)
        return pa.table({"part": group.column("part").slice(0, 1), "summary": pa.array([_pack(_top(total, keep))], pa.binary())})

    schema = "part int, summary binary"
    parts = docs.select("text").mapInArrow(summarise, schema)
    for groups in (1024, 32):
        parts = parts.withColumn("part", (F.col("part") % groups).cast("int")).groupBy("part").applyInArrow(merge, schema)
    total: Counter = Counter()
    for row in parts.collect():  # 32 summaries at most
        total.update(_unpack(bytes(row["summary"])))
    return list(_top(total, keep))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of any columns of these names."""
    spark = docs.sparkSession
    names = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in names]
    frequent = frequent_pretokens(docs, path)
    lengths = dict(zip(frequent, Counts(path or default_model()).whole(frequent), strict=True)) if frequent else {}
    shared = spark.sparkContext.broadcast(lengths)
    name = uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (path, name)
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = Counts(path or default_model(), shared.value)
        for batch in batches:
            yield pd.Series(_COUNTS[key].count([t if t is not None else "" for t in batch]), dtype="int64")

    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    out = docs.select(*keep, n_bytes.alias("n_bytes"), tokens("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), path).drop("text")
