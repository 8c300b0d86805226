"""Chunkers: a passage's sentences become spans, spans become chunk rows.

A span is a struct of the first and last sentence (from 0, inclusive). ``sliding`` is a closed form
and ``structure`` a look-ahead and a walk, both in the JVM; ``semantic`` needs sentence vectors and
runs as one Arrow UDF over those passages only that are to be cut so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.config import ChunkConfig
from ragweave.functions import text as X

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
NO_SPANS = "array<struct<first:int,last:int>>"
STRATEGIES = ("structure", "semantic", "sliding", "adaptive")
#: Sentences, and their characters, whose vectors are made at once.
SLAB, SLAB_CHARS = 1024, 1 << 18


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def sliding(n: Column, cfg: ChunkConfig) -> Column:
    """Windows of ``window`` sentences, each ``window - window_overlap`` after the one before."""
    width = max(1, cfg.window)
    stride = max(1, width - max(0, min(cfg.window_overlap, width - 1)))
    count = F.greatest(F.ceil((n - width) / stride), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), count), lambda k: _span(k * stride, F.least(n - 1, k * stride + (width - 1))))
    return F.when(n > 0, spans).otherwise(F.array().cast(NO_SPANS))


def structure(df: DataFrame, lengths: str, out: str, cfg: ChunkConfig, only: Column | None = None) -> DataFrame:
    """Add ``out``: spans of up to ``target_sentences`` sentences and ``target_chars`` characters; none unless ``only``.

    ``lengths`` names a column of sentence lengths. How far a span from a given sentence reaches
    depends on that sentence alone: it grows while the joined length fits, a condition on prefixes.
    The walk then hops from span to span.
    """
    reach = min(cfg.target_sentences, cfg.max_sentences)
    back = max(0, min(cfg.overlap, cfg.target_sentences - 1))
    size = F.size(lengths)

    def last(first: Column) -> Column:
        total, fits, end = F.get(F.col(lengths), first), F.lit(True), first
        for k in range(1, reach):
            total = total + 1 + F.get(F.col(lengths), first + k)
            limit = F.lit(cfg.max_chars) if k < cfg.min_sentences else F.lit(min(cfg.target_chars, cfg.max_chars))
            fits = fits & F.coalesce(total <= limit, F.lit(False))
            end = F.when(fits, first + k).otherwise(end)
        return end

    wanted = size > 0 if only is None else only & (size > 0)
    ends = F.when(wanted, F.transform(F.sequence(F.lit(0), size - 1), last)).otherwise(F.array().cast("array<int>"))
    # A generator keeps the ends a column: they are indexed at each hop.
    df = df.select("*", F.inline(F.array(F.struct(ends.alias("__ends")))))
    start = F.struct(F.lit(0).alias("next"), F.array().cast(NO_SPANS).alias("spans"))

    def hop(acc: Column, end: Column, i: Column) -> Column:
        onward = F.when(end >= size - 1, size).otherwise(F.greatest(end - back + 1, i + 1)) if back else end + 1
        here = acc["next"] == i
        return F.struct(F.when(here, onward).otherwise(acc["next"]).alias("next"), F.when(here, F.concat(acc["spans"], F.array(_span(i, end)))).otherwise(acc["spans"]).alias("spans"))

    pairs = F.transform("__ends", lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    walked = F.aggregate(pairs, start, lambda acc, x: hop(acc, x["e"], x["i"]), lambda acc: acc["spans"])
    return df.withColumn(out, walked).drop("__ends")


class HashedNgrams:
    """Sentence vectors of hashed character n-grams: case and white space don't count; unit length.

    An n-gram is packed into a number: its characters' places in an alphabet that grows as characters are
    met, 12 bits each, and its length. All n-grams of many sentences are then looked up at once in a table of
    fixed size, whose entries newer n-grams take over. Longer n-grams, and sentences of more different
    characters than there are places, are looked up one by one.
    """

    #: Bits of a character's place, and of the table's size; n-grams that are looked up at once.
    PLACE, TABLE, STEP = 12, 21, 1 << 18

    def __init__(self, cfg: ChunkConfig | None = None):
        self.cfg = cfg or ChunkConfig()
        self.cells: dict[str, int] = {}
        self.table: tuple[np.ndarray, ...] | None = None  # made where it is used: an embedder is sent to the workers
        self.letters = 0

    def _cell(self, gram: str) -> int:
        digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big") % self.cfg.dimensions

    def _kept(self, gram: str) -> int:
        cell = self.cells.get(gram)
        if cell is None:
            if len(self.cells) > 500_000:
                self.cells.clear()
            cell = self.cells[gram] = self._cell(gram)
        return cell

    def _placed(self, codes: np.ndarray) -> np.ndarray | None:
        """The characters' places, from 1; None if these alone are more than there are places."""
        for _ in range(2):
            if self.table is None:
                self.table = np.zeros(0x110000, np.uint16), np.zeros(1 << self.TABLE, np.uint64), np.zeros(1 << self.TABLE, np.int32)
                self.letters = 0
            places = self.table[0]
            new = np.unique(codes[places[codes] == 0])
            if self.letters + len(new) < 1 << self.PLACE:
                places[new] = np.arange(self.letters + 1, self.letters + len(new) + 1)
                self.letters += len(new)
                return places[codes]
            self.table = None
        return None

    def _looked_up(self, keys: np.ndarray, text: str, at: np.ndarray, n: int) -> np.ndarray:
        """The cells of the n-grams of ``text`` that begin ``at``."""
        _, known, cells = self.table
        slot = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.TABLE)
        out, missed = cells[slot], np.flatnonzero(known[slot] != keys)
        if len(missed):
            _, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            out[missed] = np.array([self._cell(text[i : i + n]) for i in at[missed[first]].tolist()], np.int32)[back]
            # Of several n-grams with a slot the last one stays, in both arrays.
            known[slot[missed]], cells[slot[missed]] = keys[missed], out[missed]
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        """How often each text has n-grams of each cell."""
        width, low, high = self.cfg.dimensions, self.cfg.ngram_low, self.cfg.ngram_high
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = self._placed(codes) if 0 < low and high * self.PLACE <= 60 else None
        if place is None:
            out = np.zeros((len(texts), width))
            for row, s in enumerate(texts):
                if grams := [s[i : i + n] for n in range(low, high + 1) for i in range(len(s) - n + 1)]:
                    out[row] = np.bincount([self._kept(g) for g in grams], minlength=width)
            return out
        out, lengths = np.zeros(len(texts) * width), np.array([len(s) for s in texts], np.int64)
        ends = np.cumsum(lengths)
        for begin in range(0, len(codes), self.STEP):
            at = np.arange(begin, min(begin + self.STEP, len(codes)))
            row = np.searchsorted(ends, at, "right")
            for n in range(low, high + 1):
                whole = at + n <= ends[row]
                some = at[whole]
                keys = np.full(len(some), n, np.uint64) << np.uint64(60)
                for k in range(n):
                    keys |= place[some + k].astype(np.uint64) << np.uint64(self.PLACE * k)
                out += np.bincount(row[whole] * width + self._looked_up(keys, text, some, n), minlength=len(out))
        return out.reshape(len(texts), width)

    def __call__(self, sentences: list[str]) -> np.ndarray:
        out = self._counts(["".join(s.casefold().split()) for s in sentences])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def next_to(flat: np.ndarray) -> np.ndarray:
    """Cosine of each row with the next; a zero vector is like nothing."""
    norm = np.linalg.norm(flat, axis=1)
    unit = flat / np.where(norm > 0, norm, 1)[:, None]
    return (unit[:-1] * unit[1:]).sum(1)


def slabs(sentences: Iterator[str]) -> Iterator[list[str]]:
    """The sentences in lists of up to ``SLAB`` and, a single one aside, ``SLAB_CHARS`` characters."""
    some, chars = [], 0
    for s in sentences:
        if some and (len(some) == SLAB or chars + len(s) > SLAB_CHARS):
            yield some
            some, chars = [], 0
        some.append(s)
        chars += len(s)
    if some:
        yield some


def similarities(embed: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function: cosine of each sentence with the next; a zero vector is like nothing.

    A task holds the vectors of one slab of sentences, however many rows or sentences a batch has.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, near, last = batch.flatten(), [], None
            for slab in slabs(s for at in range(0, len(flat), SLAB) for s in flat.slice(at, SLAB).to_pylist()):
                vectors = np.asarray(embed(slab))
                near.append(next_to(vectors if last is None else np.concatenate([last, vectors])))
                last = vectors[-1:]
            found = np.concatenate([*near, [0.0]]) if near else np.zeros(0)  # a place for each sentence; a row's last one is left out
            size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, kept = np.cumsum(size), np.maximum(size - 1, 0)
            inner = np.ones(len(found), bool)
            inner[ends[size > 0] - 1] = False
            offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), mask=np.append(batch.is_null().to_numpy(zero_copy_only=False), False))
            yield pa.ListArray.from_arrays(offsets, pa.array(found[inner], pa.float64()))

    return run


def semantic(df: DataFrame, lengths: str, near: str, out: str, cfg: ChunkConfig) -> DataFrame:
    """Add ``out``: spans cut where ``near`` (similarity to the next sentence) is low; none where it is null.

    Groups that are too small join the one before; groups that are too large are cut as by
    ``structure``, which is one more pass over the groups that need it.
    """
    size = F.when(F.col(near).isNotNull(), F.size(lengths)).otherwise(F.lit(0))
    total = lambda s: F.aggregate(F.slice(F.col(lengths), s["first"] + 1, s["last"] - s["first"] + 1), F.lit(0), lambda a, x: a + x) + s["last"] - s["first"]
    cuts = F.filter(F.transform(near, lambda x, i: F.when(x < cfg.similarity, i + 1)), lambda i: i.isNotNull())
    df = df.select("*", F.inline(F.array(F.struct(F.concat(F.array(F.lit(0)), F.coalesce(cuts, F.array().cast("array<int>")), F.array(size)).alias("__cuts")))))
    groups = F.transform(F.sequence(F.lit(1), F.size("__cuts") - 1), lambda k: _span(F.get("__cuts", k - 1), F.get("__cuts", k) - 1))

    def grow(done: Column, s: Column) -> Column:
        small = (s["last"] - s["first"] + 1 < cfg.min_sentences) | (total(s) < cfg.min_chars)
        n = F.size(done)
        wider = F.concat(F.slice(done, F.lit(1), n - 1), F.array(_span(F.get(done, n - 1)["first"], s["last"])))
        return F.when(small & (n > 0), wider).otherwise(F.concat(done, F.array(s)))

    merged = F.when(size > 0, F.aggregate(groups, F.array().cast(NO_SPANS), grow)).otherwise(F.array().cast(NO_SPANS))
    df = df.select("*", F.inline(F.array(F.struct(merged.alias("__merged"))))).drop("__cuts")
    # Cut every large group by structure: the walk of the whole passage can't be used, groups restart it.
    reach = min(cfg.target_sentences, cfg.max_sentences)
    back = max(0, min(cfg.overlap, cfg.target_sentences - 1))

    def last(first: Column, bound: Column) -> Column:
        sum_, fits, end = F.get(F.col(lengths), first), F.lit(True), first
        for k in range(1, reach):
            sum_ = sum_ + 1 + F.get(F.col(lengths), first + k)
            limit = cfg.max_chars if k < cfg.min_sentences else min(cfg.target_chars, cfg.max_chars)
            fits = fits & (first + k <= bound) & F.coalesce(sum_ <= limit, F.lit(False))
            end = F.when(fits, first + k).otherwise(end)
        return end

    def cut(s: Column) -> Column:
        start = F.struct(s["first"].alias("next"), F.array().cast(NO_SPANS).alias("spans"))

        def hop(acc: Column, i: Column) -> Column:
            end, here = last(i, s["last"]), acc["next"] == i
            onward = F.when(end >= s["last"], s["last"] + 1).otherwise(F.greatest(end - back + 1, i + 1)) if back else end + 1
            return F.struct(F.when(here, onward).otherwise(acc["next"]).alias("next"), F.when(here, F.concat(acc["spans"], F.array(_span(i, end)))).otherwise(acc["spans"]).alias("spans"))

        fits = (s["last"] - s["first"] + 1 <= cfg.max_sentences) & (total(s) <= cfg.max_chars)
        return F.when(fits, F.array(s)).otherwise(F.aggregate(F.sequence(s["first"], s["last"]), start, hop, lambda acc: acc["spans"]))

    return df.withColumn(out, F.flatten(F.transform("__merged", cut))).drop("__merged")


def passages(df: DataFrame) -> DataFrame:
    """Passage rows as the chunkers want them: a castable query_id, some text, ids and lengths filled in."""
    have = set(df.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    df = df.withColumn("query_id", F.try_to_number(F.col("query_id").cast("string"), F.lit("S999999999999999999")).cast("long")) if dict(df.dtypes)["query_id"] == "string" else df
    df = df.where(F.col("query_id").isNotNull() & (X.squeeze_ends(F.coalesce("text", F.lit(""))) != ""))
    index, language = F.coalesce(col("passage_index", "int"), F.lit(0)), F.coalesce(col("language", "string"), F.lit(""))
    df = df.withColumns({"passage_index": index, "language": language})
    own = X.passage_id(F.col("query_id"), F.col("passage_index"), F.col("language"))
    return df.withColumns({"document_id": F.coalesce(F.nullif(col("document_id", "string"), F.lit("")), own), "char_length": F.coalesce(F.nullif(col("char_length", "int"), F.lit(0)), F.length("text"))})


def with_spans(df: DataFrame, strategy: str, cfg: ChunkConfig | None = None, embed=None) -> DataFrame:
    """Add sentences, spans and reason (of the adaptive choice, else null) to rows with ``text``."""
    cfg, near = cfg or ChunkConfig(), None
    df = df.select("*", F.inline(F.array(F.struct(X.sentences(F.col("text")).alias("sentences")))))
    df = df.select("*", F.inline(F.array(F.struct(F.transform("sentences", F.length).alias("__len")))))
    n = F.size("sentences")
    if strategy == "sliding":
        return df.select("*", sliding(n, cfg).alias("spans"), F.lit(None).cast("string").alias("reason")).drop("__len")
    if strategy not in ("semantic", "adaptive"):
        return structure(df, "__len", "spans", cfg).withColumn("reason", F.lit(None).cast("string")).drop("__len")
    near = similarities(embed or HashedNgrams(cfg))
    if strategy == "semantic":
        return semantic(df.withColumn("__near", near("sentences")), "__len", "__near", "spans", cfg).withColumn("reason", F.lit(None).cast("string")).drop("__len", "__near")
    chars = F.aggregate("__len", F.lit(0), lambda a, x: a + x) + F.greatest(n - 1, F.lit(0))
    settled = (
        F.when(n == 0, "structure:empty").when((n <= cfg.short_sentences) | (chars <= cfg.short_chars), "structure:short_passage")
        .when((n >= cfg.long_sentences) | (chars >= cfg.long_chars), "sliding:long_passage").when(n < cfg.shift_sentences, "structure:typical_multi_sentence")
    )
    df = df.select("*", F.inline(F.array(F.struct(settled.alias("__why")))))
    # Only passages that are still undecided reach the vectors; the others are nulls there.
    df = df.withColumn("__near", near(F.when(F.col("__why").isNull(), F.col("sentences"))))
    low = F.size(F.filter("__near", lambda x: x < cfg.similarity))
    shift = (low > 0) & (low / F.size("__near") >= cfg.shift_share)
    why = F.coalesce("__why", F.when(shift, "semantic:topic_shift").otherwise("structure:typical_multi_sentence"))
    df = df.select("*", F.inline(F.array(F.struct(why.alias("reason"))))).drop("__why")
    topics = F.col("reason").startswith("semantic")
    df = df.select(*(c for c in df.columns if c != "__near"), F.when(topics, F.col("__near")).alias("__near"))
    df = structure(semantic(df, "__len", "__near", "__topics", cfg), "__len", "__walk", cfg, F.col("reason").startswith("structure"))
    spans = F.when(topics, F.col("__topics")).when(F.col("reason").startswith("sliding"), sliding(n, cfg)).otherwise(F.col("__walk"))
    return df.withColumn("spans", spans).drop("__len", "__near", "__topics", "__walk")


def chunks(df: DataFrame, strategy: str = "adaptive", cfg: ChunkConfig | None = None, embed=None) -> DataFrame:
    """Chunk rows of passages (see ``passages``): the passage's columns and the chunk's.

    chunk_index counts spans, so one without text leaves a gap.
    """
    keep = [c for c in df.columns if c not in ("text", "char_length")]
    text = lambda s: X.joined(F.slice("sentences", s["first"] + 1, s["last"] - s["first"] + 1))
    made = F.transform("spans", lambda s, i: F.struct(i.alias("chunk_index"), s.alias("span"), text(s).alias("text")))
    rows = with_spans(df, strategy, cfg, embed).select(*keep, "reason", F.inline(made))  # a chunk has its own text alone
    return rows.where("text != ''").select(
        F.concat_ws(":", F.col("document_id"), F.lit(strategy), F.col("chunk_index").cast("string")).alias("chunk_id"),
        *keep, F.col("document_id").alias("passage_id"), F.lit(strategy).alias("chunk_strategy"), "chunk_index",
        F.col("span.first").alias("start_sentence"), F.col("span.last").alias("end_sentence"), "text", F.length("text").alias("char_length"),
        (F.col("span.last") - F.col("span.first") + 1).alias("sentence_count"), F.col("reason").alias("adaptive_reason"),
    )


def first_of_each(df: DataFrame, key: str = "chunk_id", order: str = "document_id") -> DataFrame:
    """One row per key, the least by ``order`` and text; the others are repeats."""
    from pyspark.sql import Window

    ties = [order, "text"] if "text" in df.columns else [order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*ties))).where("__n = 1").drop("__n")
