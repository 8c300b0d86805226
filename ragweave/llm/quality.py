"""Quality rules with a robust multivariate outlier test, in DataFrame functions only.

Base rules look at single counts of a text. The method then takes a vector of transformed
statistics of each document and rejects it if its Mahalanobis distance from the minimum covariance
determinant (MCD) estimate of its language and source is beyond a chi-square quantile.

MCD: from each of three deterministic starts (quartiles, all rows' covariance, and the covariance of
their directions from the medians) repeat concentration steps: compute all distances, keep the
``SUPPORT`` share of rows with the smallest, and re-estimate mean and covariance from these. Steps go
on until no determinant falls any more, and each group takes its least determinant over all steps
and starts. A step is one aggregation by (group, start, distance bin): the bins that together hold
the share give the moments, the last of them in proportion. Groups are never gathered; a hot group
is a few hundred partial sums. Sums are of scaled integers, so the order of rows can't change them.
A group is judged by its own estimate if its support has more rows than the vector has coordinates,
so that there is a covariance to estimate (with ``SUPPORT`` 0.75, from 6 rows on); smaller groups by
that of their language, and languages as small by that of all documents.

Defined results: null and blank texts have zero words and fail the base rule; null languages and
sources are groups of their own; repeated rows count as often as they stand; an empty table gives
no rows; other columns are passed on by ``keep_quality`` and not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm.common import BLANK_CHARS, Tables, fence, join_checked, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
#: Added words of an average text, so that ratios of short texts lie near the centre.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5.0
#: The least standard deviation of each transformed statistic: most texts have no symbols or
#: repeats at all, and a covariance without a floor would be singular.
FLOORS = (0.06, 0.06, 0.08, 0.08)
SCALE = 10_000
SUPPORT = 0.75
#: Steps end when every determinant falls by less than this share, or after MAX_STEPS, should one cycle.
CONVERGED, MAX_STEPS = 1e-6, 60
STARTS = 3
#: Documents beyond this quantile of the chi-square distribution with 4 degrees are rejected.
QUANTILE = 0.999999
P = len(FLOORS)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _chi2_cdf(x: float, even: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(even // 2))


def _chi2_quantile(q: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, even) < q else (low, mid)
    return low


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and a struct ``__q`` of the base statistics (the names in ``STATS``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    df = docs.select(*(F.col(c) for c in keep), *([] if "text" in keep else [F.col("text")]))
    df = fence(df, __w=words(F.col("text")), __lines=lines, __sym=F.size(F.split(text, SYMBOLS)) - 1)
    if "text" not in keep:
        df = df.drop("text")
    chars = F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    df = fence(df, __h=F.transform("__w", lambda w: F.xxhash64(w)), __chars=chars).drop("__w")
    n = F.size("__h")
    at = lambda i, k: F.get(F.col("__h"), i + k)
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("__h", F.lit(1), n - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *(at(i, k) for k in range(1, WINDOW)))))
    dup = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
    df = fence(df, __g=grams, __dup=dup, __n=n.cast("long")).drop("__h", "__lines")
    pairs = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = fence(df, __s=F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs).otherwise(none)).drop("__g")
    h = lambda i: F.get(F.col("__s"), i)["h"]
    found = F.filter(F.transform("__s", lambda x, k: F.when((x["h"] == h(k - 1)) | (x["h"] == h(k + 1)), x["i"])), lambda x: x.isNotNull())
    df = fence(df, __at=F.when(F.size("__s") == 0, F.array().cast("array<int>")).otherwise(F.sort_array(found))).drop("__s")
    spans = F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), k + 1) - p, F.lit(WINDOW))))
    repeat = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("__rep", repeat).drop("__at")
    failed = (F.col("__n") < MIN_WORDS) | (F.col("__rep") * 100 > F.col("__n") * MAX_REPEAT_PERCENT)
    q = F.struct(F.col("__n").alias("n_words"), F.col("__chars").cast("long").alias("word_chars"), F.col("__sym").cast("long").alias("n_symbols"), F.col("__dup").alias("n_dup_lines"), F.col("__rep").alias("n_repeat_words"), failed.alias("base_failed"))
    return df.select(*keep, q.alias("__q"))


def vector(q: Column) -> list[Column]:
    """The transformed statistics, as integers of ``1 / SCALE``."""
    n = q["n_words"] + F.lit(PRIOR_WORDS)
    x = [
        F.log((q["word_chars"] + F.lit(PRIOR_WORDS * PRIOR_LENGTH)) / n),
        F.sqrt(q["n_symbols"] / n),
        F.sqrt(q["n_dup_lines"] / n),
        F.sqrt(q["n_repeat_words"] / n),
    ]
    return [F.round(v * SCALE).cast("long") for v in x]


def group_key(lang: str = "lang", source: str = "source") -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.concat_ws("\x01", part(lang), part(source))


def language_key(lang: str = "lang") -> Column:
    """The group of all sources of a language; no source's key ends like it."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")), F.lit("\x01*"))


def _factor(df: DataFrame, cov) -> DataFrame:
    """Columns l{i}{j} and d{i} of the factorisation L D L' of the covariance ``cov(i, j)``."""
    for j in range(P):
        d = cov(j, j)
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
        df = df.withColumn(f"d{j}", F.greatest(d, F.lit(1e-9)))
        for i in range(j + 1, P):
            v = cov(i, j)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
            df = df.withColumn(f"l{i}{j}", v / F.col(f"d{j}"))
    return df


PARAMS = [f"m{i}" for i in range(P)] + [f"d{i}" for i in range(P)] + [f"l{i}{j}" for j in range(P) for i in range(j + 1, P)]


def distance(x: list[Column], param) -> Column:
    """Squared Mahalanobis distance of the scaled vector ``x``; ``param(name)`` gives a column of PARAMS."""
    z: list[Column] = []
    for i in range(P):
        v = x[i] / F.lit(float(SCALE)) - param(f"m{i}")
        for j in range(i):
            v = v - param(f"l{i}{j}") * z[j]
        z.append(v)
    return sum((z[i] * z[i] / param(f"d{i}") for i in range(1, P)), z[0] * z[0] / param("d0"))


def _starts(rows: DataFrame, tables: Tables) -> DataFrame:
    """g, n, start and PARAMS of the estimates that concentration steps begin with."""
    three = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    x = lambda i: F.col(f"x{i}").cast("decimal(19,0)")
    sums = {f"s{i}": F.sum(x(i)) for i in range(P)} | {f"s{i}{j}": F.sum(x(i) * x(j)) for i, j in pairs}
    quartiles = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile(f"x{i}", three).alias(f"q{i}") for i in range(P)), *(v.cast("double").alias(k) for k, v in sums.items()))
    spread = lambda i: F.greatest(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (SCALE * 1.349), 2), F.lit(FLOORS[i] ** 2))
    base = tables.write(quartiles.select("g", "n", *(F.col(k) / F.col("n") / SCALE ** (len(k) - 1) for k in sums), *((F.col(f"q{i}")[1] / SCALE).alias(f"m{i}") for i in range(P)), *(spread(i).alias(f"v{i}") for i in range(P))).toDF("g", "n", *sums, *(f"m{i}" for i in range(P)), *(f"v{i}" for i in range(P))), 1)
    # Directions: rows scaled by the spreads, to length one; their products as integers too.
    away = join_checked(rows, base.select("g", *(f"m{i}" for i in range(P)), *(f"v{i}" for i in range(P))), "g")
    z = [(F.col(f"x{i}") / SCALE - F.col(f"m{i}")) / F.sqrt(f"v{i}") for i in range(P)]
    square = sum((v * v for v in z[1:]), z[0] * z[0])
    turned = away.select("g", *(F.when(square > 0, F.round(z[i] * z[j] / square * SCALE**2)).otherwise(F.lit(0.0)).cast("decimal(19,0)").alias(f"u{i}{j}") for i, j in pairs))
    turned = turned.groupBy("g").agg(*(F.sum(f"u{i}{j}").cast("double").alias(f"u{i}{j}") for i, j in pairs))
    base = base.join(turned, "g")

    def start(k: int, mean, cov) -> DataFrame:
        at = base.withColumns({f"c{i}": mean(i) for i in range(P)})
        at = _factor(at, lambda i, j: cov(max(i, j), min(i, j)) + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0)))
        return at.select("g", "n", F.lit(k).alias("start"), *(F.col(f"c{i}").alias(f"m{i}") for i in range(P)), *PARAMS[P:])

    medians, means = (lambda i: F.col(f"m{i}")), (lambda i: F.col(f"s{i}"))
    turn = lambda i, j: F.col(f"u{i}{j}") / SCALE**2 / F.col("n") * F.sqrt(F.col(f"v{i}") * F.col(f"v{j}"))
    first = start(0, medians, lambda i, j: F.col(f"v{i}") if i == j else F.lit(0.0))
    return tables.write(first.union(start(1, means, lambda i, j: F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}"))).union(start(2, medians, turn)), 1)


def _concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step of every group and start: the estimate of the rows nearest by ``model``, and its log determinant."""
    consistency = SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, P), P + 2)
    d2 = distance([F.col(f"x{i}") for i in range(P)], F.col)
    near = join_checked(rows, model, "g").select("g", "n", "start", F.floor(F.log(d2 + 1e-4) * 16).alias("bin"), *(F.col(f"x{i}").cast("decimal(19,0)").alias(f"x{i}") for i in range(P)))
    sums = {f"s{i}": F.sum(f"x{i}") for i in range(P)} | {f"s{i}{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(P) for j in range(i + 1)}
    bins = near.groupBy("g", "n", "start", "bin").agg(F.count("*").alias("c"), *(v.cast("decimal(38,0)").alias(k) for k, v in sums.items()))
    upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = ["c", *sums]
    total = bins.select("g", "n", "start", "bin", *every, *(F.sum(k).over(upto).alias(f"{k}_all") for k in every))
    need = F.ceil(F.col("n") * SUPPORT)
    first = Window.partitionBy("g", "start").orderBy("bin")
    total = total.where(F.col("c_all") >= need).withColumn("k", F.row_number().over(first)).where("k = 1")
    over = (F.col("c_all") - need) / F.col("c")  # the share of the last bin that is beyond the support
    total = total.select("g", "n", "start", need.cast("double").alias("c"), *((F.col(f"{k}_all").cast("double") - over * F.col(k).cast("double")).alias(k) for k in sums))
    mean = lambda i: F.col(f"s{i}") / F.col("c")
    total = total.withColumns({f"m{i}": mean(i) / SCALE for i in range(P)})

    def cov(i, j):
        v = (F.col(f"s{i}{j}") / F.col("c") - mean(i) * mean(j)) * (consistency / SCALE**2)
        return v + F.lit(FLOORS[i] ** 2) if i == j else v

    out = _factor(total, cov)
    return out.select("g", "n", "start", *PARAMS, sum((F.log(f"d{i}") for i in range(1, P)), F.log("d0")).alias("log_det"))


def fit(stats: DataFrame, tables: Tables) -> DataFrame:
    """The MCD estimate of every group (g) of ``stats`` (and x0...), of the languages (__l) that small groups need, and as group '*' of all rows if a small language does.

    Returns one row per group: g, n and PARAMS.
    """
    xs = [f"x{i}" for i in range(P)]
    able = F.ceil(F.col("n") * SUPPORT) > P
    groups = tables.write(stats.groupBy("g", "__l").agg(F.count("*").alias("n")), 1)
    languages = groups.groupBy("__l").agg(F.sum("n").alias("n"), F.min(able).alias("alone")).where("not alone")
    languages = tables.write(languages.select("__l", able.alias("able")), 1)
    rows = stats.select("g", *xs)
    if not languages.isEmpty():
        rows = rows.union(join_checked(stats, languages.where("able"), "__l").select(F.col("__l").alias("g"), *xs))
        if not languages.where("not able").isEmpty():
            rows = rows.union(stats.select(F.lit("*").alias("g"), *xs))
    model = _starts(rows, tables)
    best = None
    for _ in range(MAX_STEPS):
        model = tables.write(_concentrated(rows, model), 1)
        if best is None:
            best = model
            continue
        both = best.union(model).groupBy("g", "start").agg(F.min_by(F.struct(*model.columns), "log_det").alias("b"), (F.min("log_det")).alias("least"))
        both = both.join(best.select("g", "start", F.col("log_det").alias("before")), ["g", "start"])
        both = tables.write(both.select("b.*", (F.col("least") < F.col("before") - CONVERGED).alias("fell")), 1)
        tables.drop(best)
        best = both.drop("fell")
        best._ragweave_path = both._ragweave_path
        moving = both.where("fell").select("g", "start")
        if moving.isEmpty():
            break
        model = model.join(moving, ["g", "start"], "left_semi")  # the others have their least
    return best.groupBy("g").agg(F.min_by(F.struct(*best.columns), F.struct("log_det", "start")).alias("b")).select("b.g", "b.n", *(f"b.{k}" for k in PARAMS))


def _slim(docs: DataFrame, keep: list[str]) -> DataFrame:
    cols = list(dict.fromkeys([*keep, "lang", "source"]))
    s = with_stats(docs.select(*cols, "text"), cols)
    return s.select(*keep, group_key().alias("g"), language_key().alias("__l"), *(F.col("__q")[k].alias(k) for k in STATS), *(x.alias(f"x{i}") for i, x in enumerate(vector(F.col("__q")))))


def verdicts(stats: DataFrame, model: DataFrame, tables: Tables) -> DataFrame:
    """Add ``distance2`` and ``kept`` to a table of statistics."""
    able = model.where((F.ceil(F.col("n") * SUPPORT) > P) & (F.col("g") != "*"))
    own, lang = (able.select(F.col("g").alias(key), F.struct(*PARAMS).alias(name)) for key, name in (("g", "__own"), ("__l", "__lang")))
    every = model.where("g = '*'").select(F.struct(*PARAMS).alias("__all"))  # one row
    own, lang, every = (tables.write(x, 1) for x in (own, lang, every))
    out = join_checked(join_checked(stats, own, "g", "left"), lang, "__l", "left").join(F.broadcast(every), F.lit(True), "left")
    p = F.coalesce("__own", "__lang", "__all")
    d2 = distance([F.col(f"x{i}") for i in range(P)], lambda k: p[k])
    out = out.withColumn("distance2", d2).drop("__own", "__lang", "__all")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= _chi2_quantile(QUANTILE, P)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance2 and kept of every document.

    Documents that fail the base rule have no part in the estimates.
    """
    tables = Tables(docs.sparkSession)
    stats = tables.write(_slim(docs, ["doc_id"]))
    model = fit(stats.where("not base_failed"), tables)
    return verdicts(stats, model, tables).select("doc_id", *STATS, F.round("distance2", 6).alias("distance2"), "kept")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Rows are written once beside their statistics, of which the estimates read their columns alone:
    nothing is joined back by id, so repeated or null ids can't mix rows up.
    """
    tables = Tables(docs.sparkSession)
    cols = docs.columns
    s = with_stats(docs.select(*cols), cols).select(F.struct(*cols).alias("__row"), group_key().alias("g"), language_key().alias("__l"), F.col("__q")["base_failed"].alias("base_failed"), *(x.alias(f"x{i}") for i, x in enumerate(vector(F.col("__q")))))
    s = tables.write(s.where("not base_failed"))
    model = fit(s.drop("__row"), tables)
    return verdicts(s, model, tables).where("kept").select(*(F.col("__row")[c].alias(c) for c in cols))
