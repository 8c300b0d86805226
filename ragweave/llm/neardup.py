"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are the whitespace-separated parts of the lower-cased text; a shingle is five words in a row
(all of them in a shorter text) and weighs its count times the mean inverse document frequency of
its words. Document frequencies are counted exactly over all documents. Inverse frequencies
saturate: words in at most one of ``SPARSE`` documents weigh alike, however large the corpus is. So
only the others are broadcast, and they are at most ``SPARSE`` times the mean number of distinct
words of a document (a document frequency above N / SPARSE each, of N times that mean in all).

1. Texts that are equal as word sequences are one node; all steps below work on nodes.
2. Each text is sampled ``BANDS * ROWS`` times by improved consistent weighted sampling. ``ROWS``
   samples make a band, and nodes that share a band are candidates. A pair of which fewer than
   ``LIKELY`` samples agree isn't looked at further: at similarity 0.8 that has odds of 5e-8.
3. Each band's least node is paired with the others, pairs are verified by weighted Jaccard
   similarity >= ``THRESHOLD``, and verified links are closed into classes by label propagation.
4. A band whose nodes are all of one class needs nothing more: further links would change nothing.
   In the others, every node outside the band's largest class is held against all nodes of other
   classes, first by samples and then by exact similarity. Bands are dealt out in pairs of blocks
   of bounded size, each worked on as one matrix, and a block pair returns a spanning forest of its
   links. So no link between candidates is lost, and no pair of nodes ever becomes a row: rows are
   a band's members, times the number of blocks it has.

Defined results: a document is a row, or several equal in both doc_id and text. Its id is the
doc_id; where that is null or has other texts too, all but the least by hash get a 62-bit hash of
both, above 2^62. Null and blank texts have no shingles and are classes of their own; an empty table
gives no rows; extra columns are passed on.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import Tables, join_checked, one_of_equals

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Samples of a pair that must agree for it to be verified.
LIKELY = SAMPLES // 2
#: Words in at most one of so many documents have the same inverse document frequency.
SPARSE = 1000
#: Words that a task counts at once.
COUNTED = 1_000_000
#: Rows of each table of variates; the two are indexed by different bits of a shingle's hash.
VARIATES = 1 << 14
CACHE_WORDS = 150_000
#: Nodes of a block of signatures, and characters of a block of texts.
BLOCK_NODES, BLOCK_CHARS = 1024, 4_000_000
#: Cells of a matrix that is worked on at once.
CELLS = 4_000_000
_STATE: dict = {}


class _Hashes(dict):
    """word -> the 8 bytes of its hash, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: str) -> bytes:
        h = xxhash.xxh3_64_digest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of words, in order."""
    known = _STATE.setdefault("words", _Hashes())
    return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64)


def split(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _variates() -> tuple[np.ndarray, np.ndarray]:
    """For each table row and sample: (1 / r, beta, r, r (beta - 1)) and ln c; r and c are Gamma(2, 1), beta uniform."""
    if "variates" not in _STATE:
        rng = np.random.Generator(np.random.PCG64(1810))
        gamma = lambda: -np.log((1 - rng.random((VARIATES, SAMPLES))) * (1 - rng.random((VARIATES, SAMPLES))))
        r, log_c, beta = gamma(), np.log(gamma()), rng.random((VARIATES, SAMPLES))
        _STATE["variates"] = np.stack([1 / r, beta, r, r * (beta - 1)], axis=1).astype(np.float32), log_c.astype(np.float32)
    return _STATE["variates"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def weighted(words: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) of a document's word hashes, and their weights."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    count = len(words) - n + 1
    h, w = np.full(count, n, np.uint64), np.zeros(count)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
        h ^= h >> np.uint64(32)
        w += weight_of[k : k + count]
    found, first, times = np.unique(_mix(h), return_index=True, return_counts=True)
    return found, w[first] / n * times


def sample(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent samples (shingle and level, hashed to 32 bits) of a weighted set.

    The variates of a shingle are a row of each of two tables, picked by independent bits of its
    hash: VARIATES ** 2 combinations, so that hardly two shingles of a text share both.
    """
    table, log_c = _variates()
    mask = np.uint64(VARIATES - 1)
    row, row_c = (found & mask).astype(np.int64), ((found >> np.uint64(32)) & mask).astype(np.int64)
    log_w = np.log(weight).astype(np.float32)
    best = np.full(SAMPLES, np.inf, np.float32)
    element, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    every = np.arange(SAMPLES)
    for low in range(0, len(found), 512):
        of = table[row[low : low + 512]]
        t = np.floor(log_w[low : low + 512, None] * of[:, 0] + of[:, 1])
        a = log_c[row_c[low : low + 512]] + of[:, 3] - of[:, 2] * t  # ln c - r (t - beta + 1)
        first = a.argmin(axis=0)
        least = a[first, every]
        better = least < best
        best[better] = least[better]
        element[better] = found[low + first[better]]
        level[better] = t[first[better], every[better]].astype(np.int64)
    mixed = _mix(element + (level.astype(np.uint64) + every.astype(np.uint64) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the lesser weights by sum of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


class Weights:
    """Inverse document frequencies, 1 + ln((1 + N) / (1 + max(df, N / SPARSE))), of the words of a text.

    ``words`` are sorted hashes with their document frequencies ``counts``; all others are sparse.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, documents: int):
        self.words, self.counts, self.documents = words, counts, documents
        self.known: dict[str, bytes] = {}

    def idf(self, n: int) -> float:
        return 1 + math.log((1 + self.documents) / (1 + max(n, self.documents / SPARSE)))

    def _look_up(self, word: str) -> bytes:
        h = xxhash.xxh3_64_digest(word.encode("utf-8", "surrogatepass"))
        value = np.frombuffer(h, np.uint64)[0]
        i = int(self.words.searchsorted(value))
        n = int(self.counts[i]) if i < len(self.words) and self.words[i] == value else 1
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = out = h + struct.pack("=d", self.idf(n))
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a text's words, in order, and their weights."""
        known = self.known
        pairs = np.frombuffer(b"".join([known.get(w) or self._look_up(w) for w in split(text)]), np.uint64).reshape(-1, 2)
        return pairs[:, 0].copy(), pairs[:, 1].copy().view(np.float64)

    def set_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return weighted(*self.of(text))


def weights_of(docs: DataFrame) -> Weights:
    """The weights to broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            words, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"w": pa.array(words.view(np.int64), pa.int64()), "n": pa.array(times, pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                words = word_hashes(set(split(text.as_py())))
                held.append(words)
                size += len(words)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        _STATE.pop("words", None)

    documents = docs.where(F.col("text").rlike(r"\S")).count()
    found = docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = found.where((F.col("n") > 1) & (F.col("n") * SPARSE > documents)).toArrow()
    words, counts = found.column("w").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(words)
    return Weights(words[order], counts[order], documents)


def identified(docs: DataFrame, tables: Tables) -> DataFrame:
    """``docs`` with ``__id``, equal for rows that are equal in doc_id and text only."""
    h, key = F.xxhash64("text"), F.col("doc_id").cast("long")
    ids = docs.where("doc_id is not null").groupBy(key.alias("__key")).agg(F.min(h).alias("__least"), F.max(h).alias("__most"))
    shared = tables.write(ids.where("__least != __most").select("__key", "__least"))
    made = F.xxhash64(F.lit(3), "text", key).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if shared.isEmpty():
        return docs.withColumn("__id", F.coalesce(key, made))
    out = join_checked(docs.withColumn("__key", key), shared, "__key", "left")
    out = out.withColumn("__id", F.when(F.col("__key").isNull() | (F.col("__least") != h), made).otherwise(F.col("__key")))
    return out.select(*docs.columns, "__id")


def _signed(docs: DataFrame, idf) -> DataFrame:
    """id, fp (of the word sequence, null without words) and samples of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            signs, prints = [], []
            for text in batch.column("text"):
                words, weight_of = weights.of(text.as_py())
                signs.append(sample(*weighted(words, weight_of)) if len(words) else None)
                a, b = struct.unpack("<qq", xxhash.xxh3_128_digest(words.tobytes()))
                prints.append({"a": a, "b": b} if len(words) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pair), pa.array(signs, pa.list_(pa.int32()))], names=["id", "fp", "sign"])

    return docs.select("id", "text").mapInArrow(sign, "id long, fp struct<a:bigint,b:bigint>, sign array<int>")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (x, y) of nodes whose texts are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for x, left, right in zip(batch.column("x").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                if last[0] != x:
                    last = (x, weights.set_of(left.as_py()))
                keep.append(similarity(last[1], weights.set_of(right.as_py())) >= THRESHOLD)
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("y"), F.col("text").alias("right")), "y")
    both = both.join(texts.select(F.col("id").alias("x"), F.col("text").alias("left")), "x")
    return both.select("x", "y", "left", "right").mapInArrow(verify, "x long, y long")


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many samples agree, for each row of ``x`` (a, SAMPLES) with each of ``y`` (b, SAMPLES)."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(SAMPLES):
        out += x[:, k, None] == y[None, :, k]
    return out


def all_similarities(some: list[int], sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Weighted Jaccard similarities of the sets numbered in ``some`` with all ``sets``, a few rows at a time."""
    starts = np.cumsum([0, *(len(h) for h, _ in sets)])[:-1]
    words, of = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weight, total = np.concatenate([w for _, w in sets]), np.array([w.sum() for _, w in sets])
    step = max(1, CELLS // max(len(of), 1))
    for low in range(0, len(some), step):
        rows = some[low : low + step]
        dense = np.zeros((len(rows), len(words)))
        for k, i in enumerate(rows):
            dense[k, of[starts[i] : starts[i] + len(sets[i][0])]] = sets[i][1]
        common = np.add.reduceat(np.minimum(dense[:, of], weight), starts, axis=1)
        yield rows, common / (total[rows][:, None] + total - common)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys``."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[a])
            if held and now != at:
                yield pa.Table.from_batches(held)
                held = []
            at = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(members: DataFrame, mains: Column, others: Column) -> DataFrame:
    """Deal out the rows of each band in cells: columns i, j and side (0 or 1).

    Side 0 of cell (i, j) is block i of the nodes outside the band's main class. Side 1 is block j of the
    main class or, from j = the number of those on, a later block of the nodes outside it. Members of the
    main class, which are not compared among each other, go to as many cells as there are blocks outside
    it, mostly one. The rows are at most the members, twice the nodes outside times the blocks of the main
    class, and those nodes times their own blocks: of the order of the comparisons by ``BLOCK_NODES``.
    """
    blocks = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    df = members.withColumns({"mains": blocks(mains), "others": blocks(others)})
    df = df.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    own, first = F.col("own"), F.col("mains")
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: cell(i, own, 1))
    of_other = F.transform(F.sequence(F.lit(0), first + F.col("others") - 1), lambda j: F.when((j < first) | (j - first > own), cell(own, j, 0)).when(j - first < own, cell(j - first, first + own, 1)))
    df = df.select(*members.columns, F.inline(F.when(F.col("main"), of_main).otherwise(F.filter(of_other, lambda c: c.isNotNull()))))
    return df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _across(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of a cell outside the band's main class, and of the rows to compare them with: side 1, and in the first column side 0 too."""
    side = group.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left, np.arange(len(side)) if group.column("j")[0].as_py() == 0 else np.flatnonzero(side == 1)


def _active(members: DataFrame) -> DataFrame:
    """band and id of the members (band, id, class, main, n, n_main, sign) that have a likely partner of another class in their band."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["band", "i", "j"]):
            ids, of = group.column("id").to_numpy(), group.column("class").to_numpy()
            sign = group.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
            active = np.zeros(len(ids), bool)
            some, rest = _across(group)
            step = max(1, CELLS // max(len(rest), 1))
            for low in range(0, len(some), step):
                x = some[low : low + step]
                likely = (agreeing(sign[x], sign[rest]) >= LIKELY) & (of[x][:, None] != of[rest])
                active[x] |= likely.any(1)
                active[rest] |= likely.any(0)
            if active.any():
                yield pa.RecordBatch.from_pydict({"band": np.full(active.sum(), group.column("band")[0].as_py(), np.int64), "id": ids[active]})

    cells = _block_pairs(members.select("band", "id", "class", "main", "n", "n_main", "sign"), F.col("n_main") / BLOCK_NODES, (F.col("n") - F.col("n_main")) / BLOCK_NODES)
    return cells.mapInArrow(look, "band long, id long").distinct()


def _linked(members: DataFrame, idf) -> DataFrame:
    """Links (x, y) that join all members (band, id, class, main, chars, main_chars, text) with a similar member of another class in their band to its class."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for group in _groups(batches, ["band", "i", "j"]):
            ids, of = group.column("id").to_numpy(), group.column("class").to_numpy()
            sets = [weights.set_of(t.as_py()) for t in group.column("text")]
            root = {c: c for c in of.tolist()}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    c = root[c] = root[root[c]]
                return c

            links = []
            some, rest = _across(group)
            for rows, found in all_similarities(list(range(len(some))), [sets[i] for i in some] + [sets[i] for i in rest]) if len(some) and len(rest) else ():
                for k, near in zip(rows, found[:, len(some) :] >= THRESHOLD, strict=True):
                    x = some[k]
                    _, first = np.unique(of[rest[near]], return_index=True)  # one of each class
                    for y in rest[near][first]:
                        a, b = find(int(of[x])), find(int(of[y]))
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            links.append((int(ids[x]), int(ids[y])))
            if links:
                yield pa.RecordBatch.from_pydict({"x": pa.array([x for x, _ in links], pa.int64()), "y": pa.array([y for _, y in links], pa.int64())})

    cells = _block_pairs(members, F.col("main_chars") / BLOCK_CHARS, (F.col("chars") - F.col("main_chars")) / BLOCK_CHARS)
    return cells.mapInArrow(link, "x long, y long")


def closed(links: DataFrame, tables: Tables, old: DataFrame | None = None) -> DataFrame:
    """id and class (its least member) of every node in ``links`` (x, y) and in the classes ``old``."""
    edges = links.select(F.col("x").alias("id"), F.col("y").alias("other"))
    if old is not None:  # a node's class stands for the links that made it
        edges = edges.union(old.where("id != class").select("id", F.col("class").alias("other")))
    edges = tables.write(edges.union(edges.select("other", "id")).distinct())
    label = tables.write(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("class")))
    while True:
        near = join_checked(edges, label.select(F.col("id").alias("other"), F.col("class").alias("seen")), "other").groupBy("id").agg(F.min("seen").alias("seen"))
        # Shortcut: also the class of the class.
        jump = label.select(F.col("id").alias("class"), F.col("class").alias("further"))
        step = join_checked(label.join(near, "id"), jump, "class", "left")
        step = step.select("id", F.least("class", "seen", "further").alias("class"), (F.least("seen", "further") < F.col("class")).alias("changed"))
        new = tables.write(step)
        done = new.where("changed").isEmpty()
        tables.drop(label)
        label = new
        if done:
            tables.drop(edges)
            out = label.select("id", "class")
            out._ragweave_path = label._ragweave_path
            return out


def classes(docs: DataFrame, tables: Tables) -> DataFrame:
    """id, class_id and copies of every document of ``docs`` (__id and text): those of a class are near duplicates, directly or by others.

    ``class_id`` is the least id of the class and ``copies`` the rows with the id.
    """
    spark, before = docs.sparkSession, list(tables.live)
    docs = docs.select(F.col("__id").alias("id"), "text")
    idf = spark.sparkContext.broadcast(weights_of(docs))
    rows = tables.write(_signed(docs, idf))
    # One node for equal texts: the least id. Blank texts are nodes of their own.
    by_text = tables.write(rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("sign").alias("sign")))
    copied = tables.write(by_text.where("n > 1").select("fp", F.col("id").alias("x")))
    same = join_checked(rows.where("fp is not null").select("fp", F.col("id").alias("y")), copied, "fp").select("x", "y").where("x != y").distinct()
    # Bands that several nodes share.
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sign", k * ROWS + 1, F.lit(ROWS))))
    banded = by_text.select("id", F.explode(key).alias("band"))
    several = tables.write(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"))
    shared = tables.write(join_checked(banded, several, "band"))
    signs = by_text.select("id", "sign")

    def texts_of(ids: DataFrame) -> DataFrame:
        return tables.write(join_checked(docs, tables.write(ids.distinct()), "id").dropDuplicates(["id"]))

    # The least node of each band with the others.
    stars = shared.where("id != least").select(F.col("least").alias("x"), F.col("id").alias("y")).distinct()
    stars = stars.join(signs.select(F.col("id").alias("y"), F.col("sign").alias("sy")), "y").join(signs.select(F.col("id").alias("x"), F.col("sign").alias("sx")), "x")
    agree = F.size(F.filter(F.zip_with("sx", "sy", lambda a, b: a == b), lambda same: same))
    stars = tables.write(stars.where(agree >= LIKELY).select("x", "y"))
    label = closed(tables.write(_verified(stars, texts_of(stars.select(F.explode(F.array("x", "y")).alias("id"))), idf)), tables)
    # What is left between classes of a band.
    now = tables.write(join_checked(shared.where("n > 2").select("band", "id", "n"), label, "id", "left").select("band", "id", "n", F.coalesce("class", "id").alias("class")))
    sizes = now.groupBy("band", "class").agg(F.count("*").alias("c"))
    open_ = tables.write(sizes.groupBy("band").agg(F.max(F.struct("c", "class")).alias("most"), F.count("*").alias("several")).where("several > 1").select("band", F.col("most.class").alias("main_class"), F.col("most.c").alias("n_main")))
    members = join_checked(now, open_, "band").withColumn("main", F.col("class") == F.col("main_class")).drop("main_class")
    active = tables.write(_active(members.join(signs, "id")))
    members = join_checked(members.drop("n", "n_main"), active, ["band", "id"])
    members = tables.write(members.join(texts_of(active.select("id")), "id"))
    chars = tables.write(members.groupBy("band").agg(F.sum(F.length("text") + 1).alias("chars"), F.sum(F.when(F.col("main"), F.length("text") + 1).otherwise(0)).alias("main_chars")))
    found = tables.write(_linked(join_checked(members, chars, "band"), idf))
    # Documents: their text's class, by way of the node.
    final = closed(found.union(same), tables, label)
    ids = rows.groupBy("id").agg(F.count("*").alias("copies"))
    out = tables.write(join_checked(ids, final, "id", "left").select("id", F.coalesce("class", "id").alias("class_id"), "copies"))
    tables.keep_only(out, *before)
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and copies (equal rows) of every document."""
    tables = Tables(docs.sparkSession)
    docs = identified(docs.select("doc_id", "text"), tables)
    every = classes(docs, tables).select(F.col("id").alias("doc_id"), "class_id", "copies")
    made = every.where(F.col("doc_id") >= 1 << 62)  # ids of rows whose doc_id doesn't tell them apart
    if made.isEmpty():
        return every
    names = tables.write(docs.where(F.col("__id") >= 1 << 62).select(F.col("__id").alias("id"), F.col("doc_id").alias("own")).distinct())
    return join_checked(every, names.withColumn("known", F.lit(True)), F.col("doc_id") == F.col("id"), "left").select(F.when(F.col("known"), F.col("own").cast("long")).otherwise(F.col("doc_id")).alias("doc_id"), "class_id", "copies")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id, and one of its equal rows."""
    tables = Tables(docs.sparkSession)
    out = identified(docs, tables)
    stays = tables.write(classes(out, tables).where("id = class_id").select(F.col("id").alias("__id"), (F.col("copies") > 1).alias("__repeated")))
    out = join_checked(out, stays, "__id")
    once = out.where("not __repeated").select(*docs.columns)
    if stays.where("__repeated").isEmpty():
        return once
    return once.unionByName(one_of_equals(out.where("__repeated"), ["__id"], docs.columns))
