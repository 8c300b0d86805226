"""Exact percentiles of groups of any size, by narrowing ranges.

What is wanted of a group are the values at some places of its sorted values. A place starts with the
range of all values. While a range holds more than ``LIMIT`` values, a mergeable sketch gives splitters
of it, one pass counts the values below, at and above three of them around the place, and the range
shrinks some 150 times. What is left is counted by value and sorted. No group is ever gathered or
sorted in one task: only ranges (a row for each group and place) and counts are brought together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.functions.session import settled, stable_unions

#: Values of a range that may be counted by value and sorted in a task.
LIMIT = 100_000
#: Splitters of a sketch, and how many of them lie between a place and the ends of its next range.
SPLITS, AROUND = 1000, 3
#: Ranges that are broadcast to the values.
BROADCAST_RANGES = 100_000


def _within() -> Column:
    v = F.col("__v")
    low = F.col("lo").isNull() | (v > F.col("lo")) | ((v == F.col("lo")) & ~F.col("lo_open"))
    high = F.col("hi").isNull() | (v < F.col("hi")) | ((v == F.col("hi")) & ~F.col("hi_open"))
    return low & high


def _met(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Values with each range of their group that they lie in."""
    few = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    named = ranges.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__c").alias("__column"), "alias", "part", "i", "m", "lo", "lo_open", "hi", "hi_open", *([c] if (c := "cuts") in ranges.columns else []))
    same = F.col("__c") == F.col("__column")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return values.join(F.broadcast(named) if few else named, same).where(_within())


def _narrowed(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The ranges after one round: ``value`` where the place was hit."""
    key = [*by, "__c", "alias", "part"]
    kept = ["i", "m", "lo", "lo_open", "hi", "hi_open"]
    grid = [k / SPLITS for k in range(SPLITS + 1)]
    met = _met(values, ranges, by).groupBy(*key, *kept)
    cut = settled(met.agg(F.percentile_approx("__v", grid, F.lit(10_000)).alias("cuts")))
    at = F.floor(F.col("i") * SPLITS / F.col("m"))
    pick = lambda k: F.element_at("cuts", (F.greatest(F.lit(0), F.least(F.lit(SPLITS), at + k)) + 1).cast("int"))
    cut = cut.withColumn("cuts", F.array(pick(-AROUND), pick(0), pick(AROUND + 1)))
    v, a, p, b = F.col("__v"), *(F.get("cuts", F.lit(k)) for k in range(3))
    met = _met(values, cut, by).groupBy(*key, *kept, "cuts")
    n = met.agg(F.count_if(v < a).alias("below"), F.count_if(v < p).alias("under"), F.count_if(v == p).alias("equal"), F.count_if(v <= b).alias("upto"))
    i, past = F.col("i"), F.col("under") + F.col("equal")
    hit = (i >= F.col("under")) & (i < past)
    to = lambda lo, lo_open, hi, hi_open, i, m: F.struct(lo.alias("lo"), lo_open.alias("lo_open"), hi.alias("hi"), hi_open.alias("hi_open"), i.cast("long").alias("i"), m.cast("long").alias("m"))
    yes, no = F.lit(True), F.lit(False)
    lo, lo_open, hi, hi_open = (F.col(c) for c in ("lo", "lo_open", "hi", "hi_open"))
    new = (
        F.when((i < F.col("under")) & (i < F.col("below")), to(lo, lo_open, a, yes, i, F.col("below")))
        .when(i < F.col("under"), to(a, no, p, yes, i - F.col("below"), F.col("under") - F.col("below")))
        .when(i < F.col("upto"), to(p, yes, b, no, i - past, F.col("upto") - past))
        .otherwise(to(b, yes, hi, hi_open, i - F.col("upto"), F.col("m") - F.col("upto")))
    )
    return settled(n.select(*key, F.when(hit, p).alias("value"), new.alias("r")).select(*key, "value", "r.*"))


def at_places(df: DataFrame, by: list[str], places: dict[str, tuple[str, Callable[[Column], list[Column]]]], limit: int | None = None) -> DataFrame:
    """``by``, ``__alias``, ``__part``, ``__n`` and ``__value``: for each alias the values of a column at the places that a function of n gives.

    Nulls and NaN are left out; a group without values has no rows.
    """
    limit = LIMIT if limit is None else limit
    stable_unions(df.sparkSession)
    columns = list(dict.fromkeys(c for c, _ in places.values()))
    given, by = by, [f"__by{k}" for k in range(len(by))]  # names that no column has
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    values = df.select(*(F.col(c).alias(b) for b, c in zip(by, given, strict=True)), F.inline(F.array(*(F.struct(F.lit(c).alias("__c"), number(c).alias("__v")) for c in columns)))).where("__v is not null")
    key = [*by, "__c", "alias", "part"]
    asked = F.array(*(F.struct(F.lit(c).alias("of"), F.lit(alias).alias("alias"), F.lit(k).alias("part"), i.cast("long").alias("i")) for alias, (c, where) in places.items() for k, i in enumerate(where(F.col("n")))))
    none = F.lit(None).cast("double")
    start = values.groupBy(*by, "__c").agg(F.count("*").alias("n")).select(*by, "__c", "n", F.inline(asked)).where("of = __c").drop("of")
    start = settled(start.withColumns({"m": F.col("n"), "lo": none, "lo_open": F.lit(False), "hi": none, "hi_open": F.lit(False)}))
    ranges, found = start.drop("n"), None
    while not (wide := ranges.where(F.col("m") > limit)).isEmpty():
        round_ = _narrowed(values, wide, by)
        got = round_.where("value is not null").select(*key, "value")
        found = got if found is None else found.unionByName(got)
        ranges = settled(ranges.where(F.col("m") <= limit).unionByName(round_.where("value is null").drop("value")))
    counted = _met(values, ranges, by).groupBy(*key, "i", "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*key).orderBy("__v"))
    last = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("i")) & (F.col("__upto") - F.col("__n") <= F.col("i"))).select(*key, F.col("__v").alias("value"))
    out = last if found is None else last.unionByName(found)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"v.{c}")) for c in key]
    joined = start.select(*key, "n").alias("n").join(out.alias("v"), [c for c in same], "inner")
    return joined.select(*(F.col(f"n.{b}").alias(c) for b, c in zip(by, given, strict=True)), *(F.col(f"{t}.{c}").alias(f"__{c}") for t, c in (("n", "alias"), ("n", "part"), ("n", "n"), ("v", "value"))))


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, Callable[[Column], Column] | float]], limit: int | None = None) -> DataFrame:
    """``by`` and each alias: the value of a column at an index of n, or, for a number p, at p percent, linear between ranks."""

    def where(how) -> Callable[[Column], list[Column]]:
        if callable(how):
            return lambda n: [how(n)]
        return lambda n: [F.floor(F.lit(how / 100) * (n - 1)), F.ceil(F.lit(how / 100) * (n - 1))]

    got = at_places(df, by, {alias: (c, where(how)) for alias, (c, how) in wanted.items()}, limit)

    def value(alias: str, how) -> Column:
        one = lambda k: F.max(F.when((F.col("__alias") == alias) & (F.col("__part") == k), F.col("__value")))
        if callable(how):
            return one(0)
        at = F.lit(how / 100) * (F.max(F.when(F.col("__alias") == alias, F.col("__n"))) - 1)
        return F.when(F.floor(at) == F.ceil(at), one(0)).otherwise((F.ceil(at) - at) * one(0) + (at - F.floor(at)) * one(1))

    return got.groupBy(*by).agg(*(value(alias, how).alias(alias) for alias, (_, how) in wanted.items()))
