"""Hard negatives against brute force in whole numbers."""

import math
import random

import pytest

from ragweave.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score long, bucket int, h string"


def brute(rows):
    kept = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = tuple(math.floor(256 * v) for v in x)
        if sum(v * v for v in q) < 1 << 62:
            kept[(i, (label + 1) % 10 if i % 7 == 0 else label, q)] = None
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in kept:
        if a[0] % 50:
            continue
        scored = sorted((-dot(a[2], r[2]), r[0], r[1] == a[1]) for r in kept)
        for p, pid, _ in [s for s in scored if s[2] and s[1] != a[0]][:5]:
            found = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], pid, n + 1, nid, -p, -s) for n, (s, nid, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, 8, "clash") for r in rows], SCHEMA)
    got = hardneg.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


def vectors(rng, ids, size=6, spread=1.0):
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    out = []
    for i in ids:
        c = rng.choice(centre)
        scale = math.exp(rng.gauss(0, spread))
        out.append((i, [scale * (a + rng.gauss(0, 0.5)) for a in c], rng.choice([0, 1, 1, 1, 2, 9])))
    return out


@pytest.mark.parametrize("block,buckets,spread", [(8192, 64, 1.0), (17, 8, 2.0), (64, 4, 0.0)])
def test_against_brute_force(spark, block, buckets, spread):
    rng = random.Random(block)
    rows = vectors(rng, rng.sample(range(-300, 4000), 500), spread=spread)
    rows += rows[:30] + [(i, x, 3) for i, x, _ in rows[:10]]  # repeated rows, ids shared by unlike rows
    rows += [(5000 + i, rows[3][1], i % 3) for i in range(120)]  # copies of a vector: ties
    rows += [(None, rows[0][1], 1), (6000, None, 1), (6050, rows[0][1], None), (6100, [1.0, None], 1), (6150, [math.nan] * 6, 1), (6200, [math.inf] * 6, 1)]
    rows += [(6250, [], 1), (6300, [1.5], 1), (6301, [2.0] * 9, 2), (6350, [1e9] * 6, 1), (6351, [1e5] * 6, 2), (6353, [1.1e5] * 6, 1), (6400, [1e200] * 6, 1), (6450, [0.0] * 6, 1)]
    assert mined(spark, rows, block=block, buckets=buckets) == brute(rows)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1), (51, [0.9], 1), (52, [0.7], 2)]) == [(50, 51, 1, 52, 256 * 230, 256 * 179)]
    assert mined(spark, [(50, [1.0], 1), (51, [-0.9], 1), (52, [-0.7], 2)]) == []


def test_bounds_keep_anchors_from_short_buckets(spark, monkeypatch):
    """Most buckets are too short to hold a window's score, so few rows meet an anchor."""
    rng = random.Random(5)
    rows = vectors(rng, range(1, 2001), spread=3.0)
    met = spark.sparkContext.accumulator(0)
    meet = hardneg._meet

    def counted(anchors, dealt, keys, found, kinds):
        def seen(scores, anchor, ids, labels):
            met.add(len(ids))
            return found(scores, anchor, ids, labels)

        return meet(anchors, dealt, keys, seen, kinds)

    monkeypatch.setattr(hardneg, "_meet", counted)
    assert mined(spark, rows, buckets=32) == brute(rows)
    assert met.value < 0.8 * (40 * 2000 + 40 * 2000 / 2)
