"""The toxicity model against a record-by-record learner, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ragweave.llm import toxicity

TABLES = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_learner_against_plain_sums():
    """The same model coordinate by coordinate, in plain Python."""
    rng = random.Random(2)
    examples = [np.array(sorted(rng.sample(range(64), rng.randint(1, 9))), np.int32) for _ in range(120)]
    labels = np.array([int(3 in e or rng.random() < 0.1) for e in examples])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.01
    z, n, bias = {}, {}, 64
    weight = lambda k, pen, pen2: 0.0 if abs(z.get(k, 0.0)) <= pen else (math.copysign(pen, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + pen2)
    w = lambda k: weight(k, 0.0, 0.0) if k == bias else weight(k, l1, l2)
    order = np.random.default_rng(11)
    for _ in range(3):
        for i in order.permutation(len(examples)):
            keys = [*examples[i].tolist(), bias]
            old = {k: w(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(old.values()))) - labels[i]
            for k in keys:
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * old[k]
                n[k] = n.get(k, 0.0) + g * g
    at, found, free = toxicity.ftrl(examples, labels, 6, alpha, beta, l1, l2, 3)
    want = {k: w(k) for k in range(64) if k in z and w(k)}
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == pytest.approx(want)
    assert free == pytest.approx(w(bias))


def test_features(monkeypatch):
    h, ends = toxicity.word_hashes(pa.array(["A b, a_B\n", None, "", "é1 Ç"]))
    a, b, e1, c = (zlib.crc32(x.encode()) for x in ("a", "b", "é1", "ç"))
    assert h.tolist() == [a, b, a, b, 0, 0, e1, c] and ends.tolist() == [0, 4, 5, 6, 8]
    whole = toxicity.features(h)
    assert len(toxicity.features(h[:4])) == 2 + 2 + 2  # a b; ab ba; a_a b_b
    monkeypatch.setattr(toxicity, "WINDOW", 3)
    assert toxicity.features(h).tolist() == whole.tolist()
    assert len(toxicity.features(h[:1])) == 1


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 10)
    texts = pa.array(["x" * n for n in (3, 3, 9, 0, 0, 50, 1)] + [None])
    found = list(toxicity.slices(texts))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == 8
    assert list(toxicity.slices(pa.array([], pa.string()))) == []


def test_held_out_accuracy(spark):
    """Labels of held-out rows are not learnt from; on them most toxic documents are found, and clean ones left alone."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in toxicity.report(docs.repartition(13), flipped).collect()}
    assert {k: r["score"] for k, r in got.items()} == pytest.approx(again)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if held(r["doc_id"])}
    assert all(got[k]["held_out"] for k in truth) and len(got) == docs.count()
    toxic = [got[k]["predicted"] for k, t in truth.items() if t]
    clean = [got[k]["predicted"] for k, t in truth.items() if not t]
    assert sum(toxic) > 0.75 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    rows = [(i, " ".join(word() for _ in range(8)) + (" Vile" if i % 3 == 0 else ""), "x", 1.5) for i in range(300)]
    rows += [(None, "vile ab", "x", 1.5), (1000, None, None, None), (1001, "", "x", 0.0), (1002, "!!", "x", 0.0), (1003, "vile " * 50_000, "x", 0.0)] + rows[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r[0] is None, r[0]) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [by[i]["predicted"] for i in range(300)] == [int(i % 3 == 0) for i in range(300)]
    assert by[1003]["predicted"] == 1 and by[1000]["score"] == by[1001]["score"] == by[1002]["score"] < 0.5
    assert by[None]["held_out"] is False


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.report(docs, none).collect()] == pytest.approx([0.25, 0.25])
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.report(docs, clean).collect()] == [0, 0]
    assert toxicity.report(docs.limit(0), none).collect() == []


def test_sample_is_bounded_and_corrected(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat(CASE WHEN id % 8 = 0 THEN 'vile ' ELSE '' END, 'w', id % 50) AS text")
    labels = spark.range(4000).selectExpr("id AS doc_id", "int(id % 8 = 0 OR id % 50 = 1) AS toxic")
    tables = toxicity.Tables(spark)
    mine, share, counts = toxicity.sample(docs, labels, tables, n=300)
    taken = {r["toxic"]: r["count"] for r in mine.groupBy("toxic").count().collect()}
    assert all(150 < v <= 400 for v in taken.values()) and share[0] == pytest.approx(300 / counts[0])
    model = toxicity.fit(docs, labels, n=300)
    rate = {r["t"]: r["s"] for r in toxicity.scored(docs, model).join(labels, "doc_id").groupBy("toxic").agg({"score": "avg"}).toDF("t", "s").collect()}
    assert rate[0] < 0.1 and rate[1] > 0.7
