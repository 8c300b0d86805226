"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words (lower-cased runs of letters and digits), pairs of neighbours and
pairs with one word between, each by presence, hashed to 2^BITS coordinates. Every coordinate has its
own learning rate, which falls with the gradients that it has seen, and the L1 term keeps at zero what
has not gathered more than ``L1`` of gradient: an n-gram of a few documents never gets a weight, so a
few hundred are left of a million coordinates, which are broadcast for scoring.

The model is fitted on a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0: up to
``TRAIN_DOCS`` documents and ``TRAIN_CHARS`` characters of each label, chosen by hash, so that rare
toxic rows are all taken while they are few. The bias is corrected for the two sampling rates.
Features are made where the texts are; one task reads the sample's coordinates. Scoring is one pass
over all whole texts without a shuffle.

Defined results: a null text is an empty one, and a text without words has one empty word; of several
labels of a doc_id the greatest counts, null labels don't; documents that share an id share its label,
equal ones are learnt once; a null doc_id has no label and is not held out; without labels of both
kinds every score is (toxic + 0.5) / (labelled + 2); an empty table gives no rows; lang, source and
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import BROADCAST_ROWS, Tables

FOLDS = 5
#: Bounds of the sample that the model is fitted on, for each label.
TRAIN_DOCS = 10_000
TRAIN_CHARS = 40_000_000
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 12.0, 0.0, 4
#: Characters of texts that are taken apart at once, and words whose pairs are hashed at once.
SLICE_CHARS = 4_000_000
WINDOW = 1 << 20
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and where each text's words begin and end."""
    flat = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"[^\p{L}\p{N}]+", " ")
    split = pc.split_pattern(pc.utf8_trim(flat, " "), " ")
    words = split.flatten().dictionary_encode()
    known = np.fromiter((zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    at = np.asarray(split.offsets)
    return known[np.asarray(words.indices)], at - at[0]


def _place(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MULTIPLIERS[1]
    return ((x ^ (x >> np.uint64(29))) * MULTIPLIERS[0] >> np.uint64(64 - bits)).astype(np.int32)


def coordinates(h: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """Coordinates of a run of words: of the words, the neighbours and the pairs with a gap, in windows."""
    k, _, g = MULTIPLIERS
    for at in range(0, max(len(h), 1), WINDOW):
        w = h[at : at + WINDOW + 2]  # pairs may end in the next window
        yield _place(w[:WINDOW] * k, bits)
        yield _place(w[:-1][:WINDOW] * k + w[1:][:WINDOW] * g + np.uint64(1), bits)
        yield _place(w[:-2][:WINDOW] * k + w[2:][:WINDOW] * g + np.uint64(2), bits)


def features(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The distinct coordinates of one text."""
    return np.unique(np.concatenate([np.unique(x) for x in coordinates(h, bits)]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to SLICE_CHARS bytes of text, or one row."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE_CHARS, "right")) - 1)
        yield at, to
        at = to


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, the weights, and the bias, which has no penalty."""
    bias = 1 << bits
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            f = examples[i]
            w, free = weights(z[f], n[f], l1, l2), weights(z[bias], n[bias], 0.0, 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + free, -35, 35))) - labels[i]
            for at, v in ((f, w), (bias, free)):
                before = n[at]
                z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * v
                n[at] = before + g * g
    w = weights(z[:bias], n[:bias], l1, l2)
    at = np.flatnonzero(w)
    return at, w[at], float(weights(z[bias], n[bias], 0.0, 0.0))


@dataclass
class Model:
    """Weights by coordinate and the bias."""

    at: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << self.bits)
        dense[self.at] = self.weights
        has, out = dense != 0, np.empty(len(texts))
        for a, b in slices(texts):
            h, ends = word_hashes(texts.slice(a, b - a))
            for i in range(a, b):
                hit = [x[has[x]] for x in coordinates(h[ends[i - a] : ends[i - a + 1]], self.bits)]
                out[i] = self.bias + dense[np.unique(np.concatenate(hit))].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, tables: Tables, n: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """Documents to fit on (doc_id, text, toxic, key), the share taken of each label, and how many ids have it."""
    known = labels.where("doc_id is not null and toxic is not null").where(_fold() != 0)
    known = tables.write(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {k: min(1.0, n / v) for k, v in counts.items()}

    def taken(df: DataFrame, rates: dict[int, float], seed: int) -> DataFrame:
        if all(r >= 1 for r in rates.values()):
            return df
        rate = F.when(F.col("toxic") == 1, F.lit(rates.get(1, 1.0))).otherwise(F.lit(rates.get(0, 1.0)))
        return df.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < rate * (1 << 30))

    chosen = taken(known, share, 3).withColumnRenamed("doc_id", "__id")
    few = chosen.count() <= BROADCAST_ROWS  # about 2 n
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen) if few else chosen, F.col("doc_id") == F.col("__id")).drop("__id")
    mine = mine.groupBy("doc_id", "toxic", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))
    mine = tables.write(mine)
    length = {r["toxic"]: (r["n"], r["chars"]) for r in mine.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    more = {k: min(1.0, 2 * n / c, chars / max(total, 1)) for k, (c, total) in length.items()}
    return taken(mine, more, 5), {k: share[k] * more.get(k, 1.0) for k in share}, counts


def fit(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, bits: int = BITS, **how) -> Model:
    """The model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic), of the folds that are not held out."""
    tables = Tables(docs.sparkSession)
    mine, share, counts = sample(docs, labels, tables, n, chars)
    if len(counts) < 2:
        p = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))), bits)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                h, ends = word_hashes(part["text"])
                found = pa.array([features(h[ends[i] : ends[i + 1]], bits) for i in range(b - a)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["key"], part["toxic"], found], ["doc_id", "key", "toxic", "found"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, examples, marks = [], [], []
        for batch in batches:
            found = batch["found"]
            values, at = np.asarray(found.values), np.asarray(found.offsets)
            examples += [values[at[i] : at[i + 1]].copy() for i in range(len(batch))]
            keys += zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), strict=True)
            marks += batch["toxic"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(repr(keys[i]).encode()), keys[i]))  # however the rows came
        at, w, bias = ftrl([examples[i] for i in order], np.array([marks[i] for i in order]), bits, **how)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, bias))], ["at", "w"])

    rows = mine.mapInArrow(apart, "doc_id long, key long, toxic int, found array<int>").repartition(1).mapInArrow(learnt, "at long, w double")
    got = np.array([(r["at"], r["w"]) for r in rows.collect()])  # the weights that aren't zero, 2^bits at most
    bias = float(got[got[:, 0] < 0, 1][0]) - np.log(share[1] / share[0])
    got = got[got[:, 0] >= 0]
    return Model(got[:, 0].astype(np.int64), got[:, 1], bias, bits)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.scores(batch["text"]))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
