"""Aggregates: the three percentile definitions, recall and reciprocal rank, rounded means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions.selection import percentiles


def finite(c: Column) -> Column:
    """NaN as null, so that aggregates leave it out."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def mean_finite(c: Column, digits: int = 4) -> Column:
    return F.round(F.avg(finite(c)), digits)


def nearest(p: float):
    """Index of the nearest rank of p percent: p/100 * (n - 1), rounded half to even."""
    return lambda n: F.bround(F.lit(p / 100) * (n - 1)).cast("long")


def cut(share: float):
    """The index int(n * share), the last at most."""
    return lambda n: F.least((n * F.lit(share)).cast("long"), n - 1)


def at_indexes(df: DataFrame, by: list[str], wanted: dict) -> DataFrame:
    """``by`` and, for each alias of ``wanted``, the value at an index of the sorted values of a column (its name, index of n)."""
    return percentiles(df, by, wanted)


def beside_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row a group put side by side; null keys are groups."""
    named = right.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in right.columns if c not in by))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return left.join(named, same, "left").drop(*(f"__{c}" for c in by))


def latency(df: DataFrame, by: list[str], column: str, prefix: str = "") -> DataFrame:
    """``by``, mean, p50, p70 and p100 of a column, a row a group."""
    sums = df.groupBy(*by).agg(mean_finite(F.col(column), 3).alias(f"{prefix}mean"), F.round(F.max(finite(F.col(column))), 3).alias(f"{prefix}p100"))
    ranks = percentiles(df, by, {"__p50": (column, 50), "__p70": (column, 70)})
    ranks = ranks.select(*by, F.round("__p50", 3).alias(f"{prefix}p50"), F.round("__p70", 3).alias(f"{prefix}p70"))
    return beside_groups(sums, ranks, by).select(*by, *(f"{prefix}{c}" for c in ("mean", "p50", "p70", "p100")))


def recall_at(rank: Column, is_gold: Column, k: int) -> Column:
    """1 if any of the first ``k`` is gold, over the rows of one query."""
    return F.coalesce(F.max(F.when((rank <= k) & is_gold, F.lit(1.0))), F.lit(0.0))


def reciprocal_rank(rank: Column, is_gold: Column) -> Column:
    return F.coalesce(F.lit(1.0) / F.min(F.when(is_gold, rank)), F.lit(0.0))


def share(condition: Column, digits: int = 2) -> Column:
    """Percentage of rows."""
    return F.round(F.lit(100.0) * F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), digits)
