"""The transaction log against a replay with savepoint stacks, record by record."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from ragweave.llm import txlog

DOCS = "doc_id long, text string, source string, key string, rank long"


def replay(docs, toxic, every=txlog.EPOCH, keys=txlog.KEYS):
    """(state rows and undone rows, final store) of (doc_id, text, source), one record after the other."""
    order = lambda r: (r[0], r[2] is None, r[2] or "", crc(r) is not None, crc(r) or 0)

    def parts(doc_id):
        h = zlib.crc32(str(doc_id).encode())
        return h % 17, h // 100 % keys

    def crc(r):
        return None if r[1] is None or r[0] in toxic else zlib.crc32(f"{parts(r[0])[1]}:{r[1]}".encode())

    open_, store, out, commits = {}, {}, [], 0
    state = lambda: out.append(("state", -(-commits // every), len(store), sum(v for _, v in store.values())))
    for r in sorted((r for r in docs if r[0] is not None), key=order):
        kind, key = parts(r[0])
        stack = open_.setdefault(r[2], [[]])  # a list of changes for the start and each savepoint
        if kind <= 1:
            for i, k, v in (c for part in stack for c in part):
                store.pop(k, None) if v is None else store.__setitem__(k, (i, v))
            open_[r[2]] = [[]]
            commits += 1
            if commits % every == 0:
                state()
        elif kind == 2:
            out += [("abort", i, r[0], k) for part in stack for i, k, _ in part]
            open_[r[2]] = [[]]
        elif kind <= 4:
            stack.append([])
        elif kind <= 6:
            out += [("rollback", i, r[0], k) for i, k, _ in stack[-1]]
            stack[-1] = []
        else:
            stack[-1].append((r[0], key, crc(r)))
    out += [("abort", i, None, k) for stack in open_.values() for part in stack for i, k, _ in part]
    if commits % every:
        state()
    return out, {k: i for k, (i, _) in store.items()}


def rows(df):
    return sorted((tuple(r) for r in df.select("kind", "id", "n", "value").collect()), key=str)


@pytest.mark.parametrize("chunk_rows,fanout", [(1 << 20, 512), (40, 2), (9, 3)])
def test_against_replay(spark, chunk_rows, fanout):
    rng = random.Random(chunk_rows)
    ids = rng.sample(range(-500, 60_000), 1500)
    docs = [(i, rng.choice(["", "a", "b b", "é\n" * 50]), rng.choice(["hot"] * 5 + ["x", "", None])) for i in ids]
    docs += [(i, None, "hot") for i in rng.sample(range(60_000, 70_000), 40)]  # null texts
    docs += [(i, t, s) for i, t, s in docs[:60] for _ in range(2)] + [(i, "other", None) for i, _, _ in docs[60:90]]  # repeated rows, shared ids
    docs += [(None, "no id", "hot")] * 3
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, 1, None])) for i in ids[:300]] + [(ids[0], 0), (None, 1), (99_999, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    want, _ = replay(docs, {i for i, t in labels if t == 1})
    assert rows(txlog.report(df, lab, chunk_rows, fanout)) == sorted(want, key=str)


def test_store(spark):
    docs = [(i, f"t{i}", "abc"[i % 3]) for i in range(3000)]
    lab = spark.createDataFrame([(i, 1) for i in range(0, 3000, 50)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    changes, commits = txlog.fates(df, lab, keys=40, chunk_rows=100)
    want, store = replay(docs, set(range(0, 3000, 50)), every=10, keys=40)
    assert {r["key"]: r["doc_id"] for r in txlog.stored(changes).collect()} == store
    got = [tuple(r) for r in txlog.epochs(changes, commits, every=10, fanout=4).orderBy("epoch").collect()]
    assert got == [r[1:] for r in want if r[0] == "state"]


def test_empty_and_no_commits(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert rows(txlog.report(spark.createDataFrame([], DOCS), lab)) == []
    change = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 17 > 6)
    got = rows(txlog.report(spark.createDataFrame([(change, "t", None)], "doc_id long, text string, source string"), lab))
    assert got == [("abort", change, None, zlib.crc32(str(change).encode()) // 100 % txlog.KEYS)]


def test_scans(spark):
    df = spark.range(100).where("id % 7 != 3").select((F.col("id") % 3).alias("s"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("x"))
    for fanout in (2, 5, 1000):
        sums = {r["id"]: r["before_x"] for r in txlog.prefix_sums(df.select("id", "x"), "id", ["x"], 99, fanout).collect()}
        after = {(r["s"], r["id"]): r["next_x"] for r in txlog.next_after(df, "s", "id", ["x"], 99, fanout).collect()}
        ids = [i for i in range(100) if i % 7 != 3]
        assert sums == {i: sum(j for j in ids if j < i and j % 5 == 0) for i in ids}
        assert after == {(i % 3, i): next((j for j in ids if j > i and j % 5 == 0 and j % 3 == i % 3), None) for i in ids}
