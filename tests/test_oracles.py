"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from ragweave.plans import queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()
assert queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (x == y) or (x is not None and y is not None and not isinstance(x, (str, list, bool)) and math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=1e-6)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.limit(5).collect() is not None
