"""Percentiles by narrowing ranges against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ragweave.functions import measures as M
from ragweave.functions import selection


def linear(v, p):
    at = p / 100 * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    return v[low] if low == high else (high - at) * v[low] + (at - low) * v[high]


@pytest.mark.parametrize("limit", [1, 30, 100_000])
def test_against_sorted_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(selection, "SPLITS", 10)  # coarse splitters: many rounds, and all four outcomes of one
    rng = random.Random(limit)
    groups = {
        "even": [rng.random() for _ in range(400)], "steep": [math.exp(rng.gauss(0, 30)) * rng.choice([-1, 1]) for _ in range(300)],
        "halves": [0.0] * 150 + [1.0] * 150, "one": [7.0], None: [float(rng.randrange(5)) for _ in range(200)], "ends": [-math.inf, math.inf, 0.0, 0.0],
    }
    rows = [(g, x, 2 * x) for g, v in groups.items() for x in v] + [("even", None, None), ("even", math.nan, 1e9), ("empty", None, math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"p0": ("v", 0), "p37": ("v", 37), "p100": ("v", 100), "near": ("v", M.nearest(90)), "cut": ("w", M.cut(0.5))}
    got = {r["g"]: r for r in selection.percentiles(df, ["g"], wanted, limit).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        s, r = sorted(v), got[g]
        w = sorted([2 * x for x in v] + ([1e9] if g == "even" else []))
        assert (r["p0"], r["p100"]) == (s[0], s[-1]) and r["near"] == s[round(0.9 * (len(s) - 1))] and r["cut"] == w[min(int(len(w) * 0.5), len(w) - 1)]
        assert r["p37"] == pytest.approx(linear(s, 37), nan_ok=True)


def test_a_million_distinct_values_in_one_group(spark):
    """No window or aggregation gets more than LIMIT values of it; the places are exact."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 3.0).alias("v"))
    v = sorted((i * 7919 % 1_000_003) / 3.0 for i in range(1_000_000))
    got = selection.percentiles(df, ["g"], {"p50": ("v", 50), "p99": ("v", M.nearest(99)), "c": ("v", M.cut(0.001))}).head()
    assert got["p50"] == pytest.approx(linear(v, 50)) and got["p99"] == v[round(0.99 * 999_999)] and got["c"] == v[1000]


def test_latency_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), (None, 5.0)], "value string, v double")
    got = {r["value"]: tuple(r)[1:] for r in M.latency(df, ["value"], "v", "x_").collect()}
    assert got == {"a": (2.333, 2.0, 2.8, 4.0), "b": (None, None, None, None), None: (5.0, 5.0, 5.0, 5.0)}
