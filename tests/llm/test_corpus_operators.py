"""Operators over whole corpora against brute force on small fixtures."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragweave.llm import common, linededup, mixing, neardup, urls, warc


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(*r, "en", 0)[:5] if len(r) == 3 else r for r in rows], "doc_id long, text string, source string, lang string, n_chars int")
    return df.selectExpr("*", "1 AS size", "'x' AS target", "2 AS `__n`", "3 AS place", "4 AS id", "5 AS class_id", "6 AS line_no") if extra else df


# Mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    """Resharing in rounds, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] or sizes[s] == 0}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 9)), r.choice(["a", "b", "b", "b", "b", "é", None, "z"])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "x y z", "a"), (402, "q " * 500, "tiny")]
    df = docs(spark, rows, extra=True).repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = collections.Counter()
    for g in got:
        assert g["target"] == pytest.approx(want[g["source"]]) and g["source_size"] == sizes[g["source"]] and 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    key = lambda rows: sorted(map(repr, ([g[c] for c in ("doc_id", "size", "taken")] for g in rows)))
    assert key(got) == key(mixing.mix(df.repartition(2)).collect())
    whole = mixing.mix_documents(df)
    assert whole.columns == df.columns
    kept = collections.Counter()
    for x in whole.collect():
        kept[x["source"]] += len((x["text"] or "").split())
    assert all(abs(kept[s] - want[s]) <= 510 for s in sizes)


def test_mixing_rows_that_share_an_id(spark):
    """Ids may be null, repeat within a source and stand in several sources; equal rows are taken as often as the mix takes them all."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choices("abcdefgh", k=n))
    rows = [(None if i % 3 else 1, text(r.randint(5, 15)), "ab"[i % 2]) for i in range(60)]
    rows += [(1, "one two three", "a")] * 7 + [(None, "four five", "b")] * 5 + [(None, None, "b")] * 4
    df = docs(spark, rows).repartition(4)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), collections.Counter()
    mixed = mixing.mix(df).collect()
    for g in mixed:
        taken[g["source"]] += g["taken"]
    assert len(mixed) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    kept = collections.Counter()
    for x in mixing.mix_documents(df).collect():
        kept[x["source"]] += len(x["text"].split())
    assert all(abs(kept[s] - want[s]) <= 15 for s in want)


def test_mixing_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


# Line dedup -----------------------------------------------------------------------------------


def near(a, b):
    """Word edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y), None)
    return p is None or a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute_lines(rows, order=None):
    """{(place, line number): whether an earlier line is only near} of the lines that go; places are ids, or ``order`` by row."""
    places = {}
    for k, (i, t, *_) in enumerate(rows):
        at = order[k] if order else i
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if w:
                places[at, n] = w
    gone = {}
    first = {}
    for at in sorted(places):
        first.setdefault(places[at], at)
    lines = sorted(first, key=first.get)
    for at, w in places.items():
        if first[w] != at:
            gone[at] = False
        elif any(first[v] < at and v != w and max(len(v), len(w)) >= linededup.MIN_WORDS and near(v, w) for v in lines):
            gone[at] = True
    return gone


def line_rows(seed, n):
    r = random.Random(seed)
    base = [[r.choice("abcd") for _ in range(r.randint(1, 9))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(base))
            if r.random() < 0.5:
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [r.choice("abcdef")] * r.randint(0, 2)
            lines.append(r.choice(["", " "]) + "  ".join(w))
        rows.append((i, "\n".join(lines), "s"))
    return rows


def line_places(spark, rows):
    """The place of each row, as the operator orders rows."""
    numbered = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    found = {r["k"]: tuple(r["p"]) for r in numbered.select("k", linededup.place_of(F.col("doc_id"), F.col("text")).alias("p")).collect()}
    return [found[k] for k in range(len(rows))]


#: Null ids, ids of two texts, and rows equal in both.
ODD_ROWS = [
    (900, None, "s"), (901, "", "s"), (903, " \n\t", "s"), (903, " \n\t", "s"),
    (None, "a b c d e f g\nonly here once\nits own line", "s"), (None, "totally other words stand here\na second line of it", "s"), (None, "its own line\na b c d e f h", "s"), (None, None, "s"),
    (902, "one two three four five six\n" * 50, "s"), (907, "p q r s t u v w\nshared by two of them", "s"), (907, "unique first line of the other\np q r s t u v x", "s"),
    (908, "stands twice under one id\nand so does this", "s"), (908, "stands twice under one id\nand so does this", "t"), (None, "null and twice", "s"), (None, "null and twice", "s"),
]


@pytest.mark.parametrize(("seed", "bound"), [(1, None), (2, None), (3, 0)])
def test_line_dedup(spark, monkeypatch, seed, bound):
    if bound is not None:  # beyond the broadcast bound the result is the same
        monkeypatch.setattr(common.join_checked, "__defaults__", ("inner", bound, None))
    rows = [*line_rows(seed, 150 if bound is None else 40), *ODD_ROWS]
    df = docs(spark, rows, extra=True).repartition(6)
    order = line_places(spark, rows)
    found = linededup.dropped_lines(df, common.Tables(spark)).distinct().collect()
    got = {(tuple(r["place"]), r["line_no"]): r["near"] for r in found}
    want = brute_lines(rows, order)
    assert len(found) == len(got) and got == want and any(want.values())
    rest = collections.Counter()
    report = collections.Counter()
    seen = set()
    for (i, t, *_), at in zip(rows, order, strict=True):
        lines = (t or "").split("\n")
        worded = [n for n, x in enumerate(lines) if x.split()]
        again = bool(worded) and at in seen
        seen.add(at)
        gone = worded if again else [n for n in worded if (at, n) in want]
        near_ = 0 if again else sum(want[at, n] for n in gone)
        left = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        report[i, len(worded), len(gone) - near_, near_, ",".join(map(str, gone)), hashlib.sha256(left.encode()).hexdigest()] += 1
        if not gone or left.split():
            rest[i, left if gone else t] += 1
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == rest
    assert collections.Counter(map(tuple, linededup.report(df).collect())) == report


def test_unique_lines_of_shared_ids_stay(spark):
    rows = [(1, "a b c d e f", "s"), (None, "a b c d e f\nunique to it", "s"), (None, "totally other words stand here\nsecond line", "s"), (7, "one two three four\nfive", "s"), (7, "a b c d e f\nsix", "s")]
    got = {r["text"] for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {"a b c d e f", "unique to it", "totally other words stand here\nsecond line", "one two three four\nfive", "six"}


def test_neighbourhood_by_brute_force(spark):
    r = random.Random(4)
    lines = [["w%d" % r.randrange(4) for _ in range(n)] for n in (1, 2, 3, 5, 63, 64, 65, 130, 200)]
    keys = linededup.neighbourhood(spark.createDataFrame([(k, w) for k, w in enumerate(lines)], "at long, w array<string>")).collect()
    assert len(keys) == sum(map(len, lines)) + len(lines)
    plain = lambda k, i: tuple(w for n, w in enumerate(lines[k]) if n != i)
    by_key, by_words = {}, {}
    for x in keys:
        by_key.setdefault((x["u"], x["v"]), set()).add(plain(x["at"], x["i"]))
        by_words.setdefault(plain(x["at"], x["i"]), set()).add((x["u"], x["v"]))
    assert all(len(v) == 1 for v in [*by_key.values(), *by_words.values()])


def test_very_long_lines(spark):
    r = random.Random(5)
    w = [str(r.randrange(10**6)) for _ in range(20_000)]
    cut = w[:7000] + w[7001:]
    began = time.monotonic()
    got = linededup.report(docs(spark, [(1, " ".join(w), "s"), (2, " ".join(cut), "s"), (3, "\n".join(w[:40]), "s")])).collect()
    assert {(x["doc_id"], x["n_near"]) for x in got} == {(1, 0), (2, 1), (3, 0)}
    assert time.monotonic() - began < 60


def test_line_dedup_empty(spark):
    assert linededup.report(docs(spark, [])).count() == 0 and linededup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("a", "b", "want"), [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True), ("a b c", "b c", True), ("a b c", "c b a", False), ("a b", "a b c d", False), ("", "a", True), ("a b c", "a b c d", True), ("x a b", "a b y", False)])
def test_one_edit(spark, a, b, want):
    df = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    assert df.select(linededup.one_edit(F.col("a"), F.col("b")).alias("x")).head()["x"] is want


# Near duplicates ------------------------------------------------------------------------------


def near_rows(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 6)))
    rows = []
    for i in range(n):
        base = [word() for _ in range(r.randint(60, 120))]
        rows.append(base)
        for _ in range(r.choice((0, 0, 1, 3, 8))):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    r.shuffle(rows)
    return [(i, " ".join(w), "s") for i, w in enumerate(rows)]


def plain_sets(texts):
    """{key: {shingle: weight}} of texts with words, from the documents frequencies of the words themselves."""
    plain = {i: t.lower().split() for i, t in texts.items() if (t or "").split()}
    df = collections.Counter(w for t in plain.values() for w in set(t))
    idf = lambda w: 1 + np.log((1 + len(plain)) / (1 + max(df[w], len(plain) / neardup.SPARSE)))
    sets = {}
    for i, t in plain.items():
        size = min(5, len(t))
        grams = collections.Counter(tuple(t[k : k + size]) for k in range(len(t) - size + 1))
        sets[i] = {g: c * sum(map(idf, g)) / size for g, c in grams.items()}
    return sets


def plain_similarity(x, y):
    low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
    return low / (sum(x.values()) + sum(y.values()) - low)


def brute_classes(rows):
    """Classes by all pairs, each with its least id."""
    sets = plain_sets({i: t for i, t, *_ in rows})
    at = {i: i for i, *_ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if at[a] != at[b] and plain_similarity(sets[a], sets[b]) >= neardup.THRESHOLD:
            least, most = sorted((at[a], at[b]))
            at = {k: least if v == most else v for k, v in at.items()}
    return at


def test_near_duplicates(spark):
    rows = near_rows(1, 60)
    k = len(rows)
    rows += [(k, None, "s"), (k + 1, "", "s"), (k + 2, " \n", "s"), (k + 3, "short text", "s"), (k + 4, "Short  TEXT", "s"), (k + 5, "x " * 40_000, "s")]
    rows += [(k + 10 + i, rows[0][1], "s") for i in range(40)]
    df = docs(spark, rows, extra=True).repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(df).collect()}
    assert got == brute_classes(rows)
    kept = neardup.dedup(df.union(df.where("doc_id = 3")))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_chains_lose_no_link(spark):
    """A chain of texts, each near the next but not the one after that: one class, whoever leads the bands."""
    r = random.Random(2)
    w = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(200)]
    rows = []
    for i in range(25):
        rows.append((i * 7 % 25, " ".join(w), "s"))
        for _ in range(3):
            w[r.randrange(len(w))] = "".join(r.choices("abcdefghijklmnop", k=5))
    got = {x["doc_id"]: x["class_id"] for x in neardup.report(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("blocks", [(1024, 4_000_000), (5, 3000)])
def test_crowded_bands_lose_no_link(spark, monkeypatch, blocks):
    """A crowd of copies of one text, many of which are similar to few others or to none, in blocks of any size."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", blocks[0])
    monkeypatch.setattr(neardup, "BLOCK_CHARS", blocks[1])
    monkeypatch.setattr(neardup, "CELLS", 1000 * blocks[0])
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    base, rows = [word() for _ in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "s"))
    want = brute_classes(rows)
    assert 3 < len(set(want.values())) < 120 and collections.Counter(want.values()).most_common(1)[0][1] > 20
    assert {x["doc_id"]: x["class_id"] for x in neardup.report(docs(spark, rows).repartition(4)).collect()} == want


@pytest.mark.parametrize(("crowd", "outside"), [(4000, 1), (900, 7), (40, 60), (0, 30), (30, 0)])
def test_cells_meet_all_pairs_once_and_deal_the_main_class_once(spark, crowd, outside):
    """Rows of cells grow with the members and with the outsiders times the blocks, not with the square of the crowd."""
    block, n = 16, crowd + outside
    members = spark.range(n).select(F.lit(5).cast("long").alias("band"), "id", (F.col("id") < crowd).alias("main"))
    got = neardup._block_pairs(members, F.lit(crowd / block), F.lit(outside / block)).collect()
    mains, others = max(1, -(-crowd // block)), max(1, -(-outside // block))
    assert len(got) <= crowd * others + 2 * outside * mains + outside * (others + 1)
    if outside <= block:
        assert len(got) == crowd + outside * mains
    cells = collections.defaultdict(lambda: ([], []))
    for r in got:
        cells[r["i"], r["j"]][r["side"]].append(r["id"])
    met = collections.Counter()
    for (_, j), (left, right) in cells.items():
        assert all(x >= crowd for x in left)
        pairs = [(x, y) for x in left for y in right] + ([(x, y) for x in left for y in left if x < y] if j == 0 else [])
        met.update((min(p), max(p)) for p in pairs)
    assert set(met.values()) <= {1} and len(met) == outside * crowd + outside * (outside - 1) // 2


def test_near_duplicates_empty_and_null(spark):
    assert neardup.report(docs(spark, [])).count() == 0 and neardup.dedup(docs(spark, [])).count() == 0
    got = neardup.dedup(docs(spark, [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "other words", "s"), (None, None, "s"), (None, None, "s")])).collect()
    assert sorted(str(x["text"]) for x in got) == ["None", "a b c d e f", "other words"]


def test_rows_that_share_an_id_are_documents(spark):
    rows = [(7, "one text of some words under this id", "s"), (7, "quite another text with the same id as that", "s"), (8, "One text of  some words under this id", "s"), (7, "one text of some words under this id", "t"), (9, "alone", "s"), (None, "quite another text with the same id as that", "s")]
    for order in (rows, rows[::-1]):
        got = neardup.dedup(docs(spark, order)).collect()
        assert sorted(" ".join(x["text"].lower().split()) for x in got) == ["alone", "one text of some words under this id", "quite another text with the same id as that"]
        by = collections.defaultdict(list)
        for x in neardup.report(docs(spark, order)).collect():
            by[x["class_id"]].append((x["doc_id"], x["copies"]))
        assert sorted(sorted(v, key=str) for v in by.values()) == sorted([[(7, 1), (None, 1)], [(7, 2), (8, 1)], [(9, 1)]], key=lambda v: sorted(v, key=str)) or sorted(map(len, by.values())) == [1, 2, 2]


def test_frequencies_saturate(monkeypatch):
    """Only words above N / SPARSE documents are looked up, and the weight is continuous there."""
    w = neardup.Weights(neardup.word_hashes(["often"]), np.array([5000]), 100_000)
    of = dict(zip("often seldom".split(), w.of("often seldom")[1], strict=True))
    assert of["often"] == pytest.approx(1 + np.log(100_001 / 5001)) and of["seldom"] == pytest.approx(1 + np.log(100_001 / 101)) == w.idf(100) == w.idf(1)


@pytest.mark.parametrize("length", [200, 3000, 15_000])
def test_recall_of_samples_on_texts_of_any_length(length):
    """Agreeing samples estimate the weighted Jaccard similarity, and similar texts share a band: recall at 0.8 to 0.85 is 0.9 or more."""
    r = random.Random(length)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    idf = dict(zip(vocabulary, (1 + r.random() * 8 for _ in vocabulary), strict=True))
    errors, shared, pairs = [], 0, 0
    while pairs < (40 if length < 15_000 else 15):
        a = r.choices(vocabulary, k=length)
        b = [r.choice(vocabulary) if r.random() < 0.02 else w for w in a]
        x, y = (neardup.weighted(neardup.word_hashes(t), np.array([idf[w] for w in t])) for t in (a, b))
        exact = neardup.similarity(x, y)
        if not 0.8 <= exact <= 0.85:
            continue
        sx, sy = neardup.sample(*x), neardup.sample(*y)
        pairs += 1
        errors.append((sx == sy).mean() - exact)
        shared += bool((sx == sy).reshape(neardup.BANDS, neardup.ROWS).all(1).any() and (sx == sy).sum() >= neardup.LIKELY)
    assert shared / pairs >= 0.9 and abs(np.mean(errors)) < 0.035 and np.std(errors) < 0.1


def test_block_kernels_by_brute_force():
    r = np.random.default_rng(3)
    ids = r.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = []
    for n in (250, 250, 1, 120, 40):
        h = np.sort(r.choice(ids, n, replace=False))
        sets.append((h, r.gamma(2, 2, n)))
    plain = [dict(zip(h.tolist(), w, strict=True)) for h, w in sets]
    for rows, found in neardup.all_similarities([0, 2, 4], sets):
        for i, row in zip(rows, found, strict=True):
            assert row == pytest.approx([plain_similarity(plain[i], y) for y in plain]) and row == pytest.approx([neardup.similarity(sets[i], y) for y in sets])
    x, y = r.integers(0, 3, (7, neardup.SAMPLES)), r.integers(0, 3, (9, neardup.SAMPLES))
    assert (neardup.agreeing(x, y) == (x[:, None] == y[None]).sum(2)).all()


def test_closed_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r["id"]: r["class"] for r in neardup.closed(links, common.Tables(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# Urls -----------------------------------------------------------------------------------------


def plain_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


URLS = ["https://WWW.Example.com/en/x?q=1#f", "http://example.com/en", "http://a.example.com/en/1", "x://notexample.com/en/", "com", None, "", "http://", "http://com/", "http://É.com/a", "a://b://c.net/es/", "http://x.net/fr/1", "http://x.net", "http://net/es/x", "http://a.com?x=/y", "http://a.com#b/c", "http://x.org/\nen/"]


def test_urls(spark):
    r = random.Random(4)
    made = [f"http://{r.choice(['good', 'fine'])}{i}.example.com/fr/{i}" for i in range(150)] + [f"http://{r.choice(['spam', 'pills'])}{i}.x.net/es/{i}" for i in range(150)]
    open_ = [f"http://good{i}.example.org/fr/{i}" for i in range(20)] + [f"http://spam{i}.x.org/es/{i}" for i in range(20)]
    every = URLS + made + open_ + made[:5] + open_[:3] + ["http://good.example.org/" + "fr/" * 40_000, "http://" + "spam." * 20_000 + "x.org"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(every)], "page_id long, url string, verdict string, score int")
    got = {x["page_id"]: x for x in urls.judge(df).collect()}
    assert len(got) == len(every)
    for i, u in enumerate(every):  # repeated urls are judged alike
        assert [got[i][c] for c in ("rule", "verdict", "score")] == [got[every.index(u)][c] for c in ("rule", "verdict", "score")]
    for i, u in enumerate(every):
        host, path = plain_url(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [(h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert got[i]["rule"] == rule[0] and (rule[1] is None or got[i]["verdict"] == rule[1])
    at = len(URLS) + len(made)
    right = [got[at + i]["verdict"] == ("allow" if i < 20 else "block") for i in range(40)]  # held out: no rule decides them
    assert sum(right) >= 36


def test_urls_without_examples(spark):
    df = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(df).collect()} == {"allow"} and urls.judge(df.limit(0)).count() == 0


def test_url_scores_by_exact_counts(spark):
    """Scores equal Witten-Bell over dictionaries, however many contexts there are."""
    r = random.Random(6)
    name = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzé0123456789-", k=r.randint(4, 20)))
    every = [f"http://{name()}.com/{name()}" for _ in range(1500)] + [f"http://{name()}.net/es/{name()}" for _ in range(1500)] + [f"http://{name()}.org/{name()}" for _ in range(60)]
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(every)], "page_id long, url string").repartition(3)).collect()
    seen = [[collections.defaultdict(collections.Counter) for _ in range(urls.ORDER + 1)] for _ in range(2)]
    texts = [x["host"] + x["path"] for x in got]
    held = spark.createDataFrame([(t,) for t in texts], "text string").select(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(urls.HELD_OUT)) == 0).collect()

    def contexts(text):
        data = b"\n" + text.encode() + b"\n"
        padded = [0] * urls.ORDER + [b + 1 for b in data]
        for at in range(1, len(data)):
            yield data[at], [tuple(padded[at + urls.ORDER - k : at + urls.ORDER]) for k in range(urls.ORDER + 1)]

    for x, text, (out,) in zip(got, texts, held, strict=True):
        if x["rule"] and not out:
            for byte, around in contexts(text):
                for order, c in enumerate(around):
                    seen[x["verdict"] == "allow"][order][c][byte] += 1

    def log_prob(model, text):
        total = []
        for byte, around in contexts(text):
            p = 1 / 256
            for order, c in enumerate(around):
                if c in model[order]:
                    n = model[order][c]
                    p = (n[byte] + len(n) * p) / (n.total() + len(n))
            total.append(np.log(p))
        return np.mean(total)

    open_ = [(x, t) for x, t in zip(got, texts, strict=True) if not x["rule"]]
    assert len(open_) == 60 and len(seen[1][5]) > 5_000
    for x, t in open_:
        assert x["score"] == pytest.approx(log_prob(seen[1], t) - log_prob(seen[0], t), abs=2e-6)


def test_escape_mass_by_distinct_continuations(spark):
    """Witten-Bell: a context with more distinct bytes after it leaves more to the shorter contexts."""
    b = lambda context, byte: sum((c + 1) * 257**k for k, c in enumerate(reversed(context))) * 256 + ord(byte)
    counts = [(b(b"a", x), 4, 1) for x in "p"] + [(b(b"z", x), 1, 1) for x in "pqrs"]
    seen = spark.createDataFrame(counts, "window long, n1 long, n0 long")
    got = {r["window"]: r["ratio"] for r in urls.log_ratios(seen, spark.createDataFrame([(b(b"a", "p"),), (b(b"z", "p"),)], "window long"), common.Tables(spark)).collect()}
    p1, p0 = (5 + 4 / 256) / 12, (2 + 4 / 256) / 9  # order 0: 8 and 5 bytes, 4 distinct
    ratio = {}
    for c, n1, n0, total1, total0, t in (("a", 4, 1, 4, 1, 1), ("z", 1, 1, 4, 4, 4)):
        q1, q0 = p1, p0
        for _ in range(urls.ORDER):  # beyond order 1 the longer contexts are as distinct
            q1, q0 = (n1 + t * q1) / (total1 + t), (n0 + t * q0) / (total0 + t)
        ratio[c] = np.log(q1) - np.log(q0)
    assert got[b(b"a", "p")] == pytest.approx(ratio["a"]) and got[b(b"z", "p")] == pytest.approx(ratio["z"])


# WARC -----------------------------------------------------------------------------------------


def record(kind, rid, url, at, status, headers, body=b"", content="application/http; msgtype=response"):
    block = f"HTTP/1.1 {status}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Date: {at}\r\n" + (f"WARC-Target-URI: {url}\r\n" if url else "") + f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize(("a", "b"), [("http://www.A.com/x/", "https://a.com:443//x?utm_source=q#f"), ("http://a.com?b=2&a=1", "http://a.com/?a=1&b=2"), ("http://a.com/%7Eu", "http://a.com/~u"), ("http://a.com/%c3%a9?x=%2f", "http://a.com/é?x=%2F"), ("http://a.com/a%zz?b&a", "http://a.com/a%25zz?a=&b=")])
def test_canonical(a, b):
    assert warc.canonical_url(a) == warc.canonical_url(b) is not None
    assert len({warc.canonical_url(f"http://a.com/{x}") for x in ("a%2Fb", "a/b", "a%FF", "a%FE", "a%20b", "a+b")}) == 6
    assert warc.canonical_url(None) is None and warc.canonical_url("mailto:x") is None and warc.canonical_url("http://a:port/") is None


def test_resolution(spark):
    day = "2024-01-0{}T0{}:00:00Z".format
    rows = [
        record("response", "r1", "http://a.com/p", day(1, 0), "200 OK", [("ETag", '"1"'), ("X-A", "old"), ("X-B", "old"), ("Content-Type", "text/html")], b"one"),
        record("response", "r2", "https://www.a.com/p/", day(1, 5), "200 OK", [("ETag", '"2"'), ("Last-Modified", "Mon")], b"two!"),
        record("response", "bad", "http://a.com/p", day(1, 6), "500 Oops", [("ETag", '"3"')]),
        record("revisit", "v1", "http://a.com/p", day(1, 3), "304 Not Modified", [("ETag", 'W/"1"'), ("X-A", "new"), ("Content-Type", "no"), ("Connection", "close")]),
        record("revisit", "v2", "http://a.com/p#f", day(3, 0), "304 Not Modified", [("ETag", '"2"')]),
        record("revisit", "v3", "http://a.com/p", day(3, 1), "304 Not Modified", [("ETag", '"9"')]),
        record("revisit", "v4", "http://a.com/p", day(3, 2), "304 Not Modified", [("Last-Modified", "Mon")]),
        record("revisit", "v5", "http://a.com/p", day(3, 3), "304 Not Modified", []),
        record("revisit", "v6", "http://b.com/", day(3, 3), "304 Not Modified", [("ETag", '"1"')]),
        record("revisit", "v7", "http://a.com/p", day(1, 0), "304 Not Modified", [("ETag", '"1"')]),
        record("revisit", "v8", None, day(3, 3), "304 Not Modified", []),
        record("revisit", "v9", "http://a.com/p", "not a date", "304 Not Modified", []),
        b"garbage", None, b"WARC/1.0\r\n\r\n",
    ]
    parsed = warc.parse_records(spark.createDataFrame([(bytearray(r) if r is not None else None, 1) for r in rows], "record binary, type int"))
    for width in (60, 3600, 10**9):
        got = {r["record_id"]: r for r in warc.resolve(parsed, width).collect()}
        said = {k: (v["outcome"], v["response_id"]) for k, v in got.items()}
        assert said == {
            "v1": ("resolved", "r1"), "v2": ("resolved", "r2"), "v3": ("changed", "r2"), "v4": ("resolved", "r2"), "v5": ("changed", "r2"),
            "v6": ("orphan", None), "v7": ("orphan", None), "v8": ("orphan", None), "v9": ("orphan", None),
        }
        assert got["v1"]["headers"] == {"etag": 'W/"1"', "x-a": "new", "x-b": "old", "content-type": "text/html"} and got["v1"]["n_body"] == 3


def test_records_without_usable_ids(spark):
    """Responses may share an id or have none; the headers are those of the response itself."""
    day = "2024-01-01T0{}:00:00Z".format
    rows = [
        record("response", "same", "http://a.com/", day(1), "200 OK", [("ETag", "a"), ("X-N", "1")], b"1"), record("response", "same", "http://b.com/", day(1), "200 OK", [("ETag", "b"), ("X-N", "2")], b"22"),
        record("response", "same", "http://a.com/", day(2), "200 OK", [("ETag", "c"), ("X-N", "3")], b"333"), record("response", "", "http://c.com/", day(1), "200 OK", [("ETag", "d"), ("X-N", "4")], b"4444"),
        record("revisit", "v1", "http://a.com/", day(3), "304 N", [("ETag", "c")]), record("revisit", "v2", "http://b.com/", day(3), "304 N", [("ETag", "b")]),
        record("revisit", "v3", "http://c.com/", day(3), "304 N", [("ETag", "d")]), record("revisit", "", "http://a.com/", "2024-01-01T01:30:00Z", "304 N", [("ETag", "a")]),
    ]
    for order in (rows, rows[::-1], rows + rows[:4]):
        table = spark.createDataFrame([(bytearray(x), 1, "x") for x in order], "record binary, at int, stored string")
        got = {x["record_id"]: (x["outcome"], x["headers"]["x-n"], x["n_body"]) for x in warc.resolve(warc.parse_records(table).selectExpr("*", "1 AS key", "2 AS block")).collect()}
        assert got == {"v1": ("resolved", "3", 3), "v2": ("resolved", "2", 2), "v3": ("resolved", "4", 4), None: ("resolved", "1", 1)}


@pytest.mark.parametrize("length", [b"-5", b"99999", b"", b"4_0", b"+3", b"x", b"9" * 30])
def test_malformed_lengths(length):
    good = record("response", "r", "http://a.com/", "2024-01-01T00:00:00Z", "200 OK", [])
    assert warc.parse_record(good)[0] == "response"
    assert warc.parse_record(re.sub(rb"Content-Length: \d+", b"Content-Length: " + length, good, count=1)) == (None,) * 8


def test_resolution_by_brute_force(spark):
    r = random.Random(5)
    rows, plain = [], []
    for i in range(300):
        kind, url, minute, tag = r.choice(["response", "revisit"]), r.choice("aab"), r.randrange(600), r.choice("xy")
        plain.append((kind, f"i{i}", url, minute, tag))
        rows.append(record(kind, f"i{i}", f"http://{url}.com/", f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "200 OK" if kind == "response" else "304 N", [("ETag", tag)], b"b"))
    parsed = warc.parse_records(spark.createDataFrame([(bytearray(x),) for x in rows], "record binary")).repartition(4)
    got = {x["record_id"]: (x["outcome"], x["response_id"]) for x in warc.resolve(parsed).collect()}
    for kind, rid, url, minute, tag in plain:
        if kind == "revisit":
            seen = [(m, i, t) for k, i, u, m, t in plain if k == "response" and u == url and m < minute]
            best = max(seen, default=None)
            assert got[rid] == (("orphan", None) if best is None else ("resolved" if best[2] == tag else "changed", best[1]))
    assert warc.resolve(parsed.limit(0)).count() == 0


def test_page_records(spark):
    pages = spark.createDataFrame([(i, f"https://s{i}.example.org/a?utm_source=x", "<p>é</p>" * i, 1) for i in range(40)] + [(40, None, None, 1)], "page_id long, url string, html string, status int")
    rows = warc.report(pages).collect()
    assert len(rows) == 82
    for r in rows:
        i = r["page_id"]
        if i == 40 or (r["revisit"] == 2 and i % 7 == 0):
            want = "orphan"
        else:
            want = "changed" if r["revisit"] == 1 and i % 5 == 0 else "resolved"
        assert (i, r["revisit"], r["outcome"]) == (i, r["revisit"], want)
