"""Blocks of dense scores are cut by the numbers that a task holds."""

import numpy as np
import pytest

from ragweave.operators import ranking


def test_slabs_are_bounded(spark, monkeypatch):
    assert ranking.slab(16_384) * 16_384 <= 1 << 20 and ranking.slab(1 << 30) == ranking.slab(0) // (1 << 20) == 1
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(60, 4)).tolist())], "doc_id long, embedding array<double>")
    for metric in ("cosine", "dot", "euclid"):
        rows = lambda: sorted(map(tuple, ranking.dense_search(df, df.withColumnRenamed("doc_id", "query_id"), 5, metric).collect()))
        want = rows()
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ranking, "slab", lambda n: 7)
            assert rows() == want and len(want) == 300
