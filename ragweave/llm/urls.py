"""URL filters: rules, and a character language-model ratio for what no rule decides.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path;
the longest fitting rule wins. Urls that an allow or block rule decides are the accepted and
rejected examples of two smoothed variable-order Markov models over the bytes of host and path.

The models count, over all labelled urls, each byte after each of its contexts of 0 to ``ORDER``
bytes. Counts are exact, in written tables with a row for each distinct context and byte, so they
grow with the urls. Probabilities interpolate from order 0 up by Witten-Bell smoothing, computed
once for each distinct context and byte to be scored and joined to the urls. The score of a url is
the difference of both models' log-likelihoods divided by its length. It is calibrated on a tenth
of the labelled urls, which is left out of the counts: the threshold is the score at which the two
error rates are balanced best, from a histogram of all held-out scores.

Defined results: null urls and urls without ``://`` have an empty host and path; without labelled
urls of both kinds the models decide nothing and everything else is allowed, as is an empty host
and path; repeated urls count as often as they stand; an empty table gives no rows; extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import BROADCAST_ROWS, Tables, join_checked

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
SCALE = 1_000_000_000
HELD_OUT = 10
BINS = 0.01
#: Widest score the calibration tells apart.
SPAN = 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), F.regexp_extract(whole, pattern, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def windows(texts: DataFrame) -> DataFrame:
    """(id, window) for every byte of every text but the first newline, from a table with ``id`` and ``text``.

    A window is a byte after its ``ORDER`` bytes of context, as one exact number: the digits of the
    context to base 257 (0 is beyond the start), nearest byte last, then the byte to base 256.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                data = [b"\n" + t.encode("utf-8", "surrogatepass") + b"\n" for t in part.column("text").to_pylist()]
                sizes = np.array([len(d) for d in data])
                flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                context = np.zeros(len(flat), np.int64)
                for back in range(ORDER, 0, -1):
                    before = np.zeros_like(flat)
                    before[back:] = flat[:-back] + 1
                    before[at < back] = 0  # beyond the start
                    context = context * 257 + before
                keep = at > 0
                ids = np.repeat(part.column("id").to_numpy(), sizes)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[keep], pa.int64()), "window": pa.array((context * 256 + flat)[keep], pa.int64())})

    return texts.select("id", "text").mapInArrow(cut, "id long, window long")


def _shorter(window: Column, order: int) -> Column:
    """The window with only ``order`` bytes of context."""
    return F.pmod(window, F.lit(257**order * 256))


def fit(labelled: DataFrame, tables: Tables) -> DataFrame:
    """window, n1 and n0: how often each distinct window stands in the accepted and rejected texts (``text``, ``kind``).

    A written table as large as the texts have distinct windows; shorter contexts are sums of it.
    """
    found = windows(labelled.select(F.col("kind").cast("long").alias("id"), "text"))
    return tables.write(found.groupBy("window").agg(F.count_if(F.col("id") == 1).alias("n1"), F.count_if(F.col("id") == 0).alias("n0")))


def log_ratios(seen: DataFrame, asked: DataFrame, tables: Tables) -> DataFrame:
    """window and ratio, the accepted minus rejected log-probability of its byte, for all windows ``asked`` (distinct).

    From order 0 up, P(byte | context) = (n + t P(byte | shorter context)) / (c + t) with n of context
    and byte, c of context and t distinct bytes after the context; an unseen context leaves the shorter's.
    """
    before = None
    for order in range(ORDER + 1):
        key = _shorter(F.col("window"), order).alias("key")
        context = F.floor(F.col("key") / 256) if order else F.lit(0)
        context = context.cast("long").alias("context")
        n = tables.write(seen.groupBy(key).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
        of = [f(k).alias(f"{name}{k}") for k in (1, 0) for name, f in (("c", lambda k: F.sum(f"n{k}")), ("t", lambda k: F.count_if(F.col(f"n{k}") > 0)))]
        c = tables.write(n.withColumn("context", context).groupBy("context").agg(*of))
        keys = asked.select(key).distinct().withColumn("context", context)
        rows = join_checked(join_checked(keys, n, "key", "left"), c, "context", "left")
        if before is None:
            rows = rows.withColumns({"p1": F.lit(1 / 256), "p0": F.lit(1 / 256)})
        else:
            rows = join_checked(rows.withColumn("short", _shorter(F.col("key"), order - 1)), before.withColumnRenamed("key", "short"), "short")
        mixed = lambda k: F.when(F.col(f"c{k}") > 0, (F.coalesce(f"n{k}", F.lit(0)) + F.col(f"t{k}") * F.col(f"p{k}")) / (F.col(f"c{k}") + F.col(f"t{k}"))).otherwise(F.col(f"p{k}"))
        before = tables.write(rows.select("key", mixed(1).alias("p1"), mixed(0).alias("p0")))
    return tables.write(before.select(F.col("key").alias("window"), (F.log("p1") - F.log("p0")).alias("ratio")))


def scored(seen: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """text and score, the mean log ratio of its bytes, of every distinct text.

    Ratios are added as integers of ``1 / SCALE``, so that the order of rows can't change a score.
    """
    texts = tables.write(texts.select("text").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = windows(texts)
    ratios = log_ratios(seen, tables.write(found.select("window").distinct()), tables)
    sums = join_checked(found, ratios, "window").groupBy("id").agg((F.sum(F.round(F.col("ratio") * SCALE).cast("long")) / F.count("*") / SCALE).alias("score"))
    return tables.write(texts.join(sums, "id").select("text", F.round("score", 6).alias("score")))


def calibrate(held_out: DataFrame) -> float:
    """The threshold with the least sum of both error rates over all held-out urls (``kind``, ``score``)."""
    bins = F.floor(F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN)) / BINS).cast("int")
    rows = held_out.select("kind", bins.alias("bin")).groupBy("kind", "bin").count().collect()  # at most 2 * 2 * SPAN / BINS
    low, high = int(-SPAN / BINS), int(SPAN / BINS) + 1
    by = {k: np.zeros(high - low + 1) for k in (0, 1)}
    for r in rows:
        by[r["kind"]][r["bin"] - low] += r["count"]
    if not by[0].sum() or not by[1].sum():
        return 0.0
    accepted_lost = np.concatenate([[0], np.cumsum(by[1])]) / by[1].sum()
    rejected_kept = 1 - np.concatenate([[0], np.cumsum(by[0])]) / by[0].sum()
    errors = accepted_lost + rejected_kept
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    middle = best[np.argmin(abs(best + low))]  # of equals, the nearest to even odds
    return float((middle + low) * BINS)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the score (null where a rule decides) of every url."""
    tables = Tables(pages.sparkSession)
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "by_rule": verdict, "text": F.concat("host", "path")})
    labelled = df.where("rule is not null").select("text", F.when(F.col("by_rule") == "allow", 1).otherwise(0).alias("kind"))
    test = F.pmod(F.xxhash64(F.lit(3), F.col("text")), F.lit(HELD_OUT)) == 0
    seen = fit(labelled.where(~test), tables)
    examples = seen.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).head()
    if not examples["n1"] or not examples["n0"]:
        out = df.withColumns({"score": F.lit(None).cast("double"), "verdict": F.coalesce("by_rule", F.lit("allow"))})
        return out.select("page_id", "host", "path", "rule", "verdict", "score")
    open_, held_out = df.where("by_rule is null"), labelled.where(test)
    scores = scored(seen, open_.select("text").union(held_out.select("text")), tables)
    few = BROADCAST_ROWS // 10  # urls are longer than the keys that the bound is meant for
    threshold = calibrate(join_checked(held_out, scores, "text", rows=few))
    decided = df.where("by_rule is not null").withColumn("score", F.lit(None).cast("double"))
    open_ = join_checked(open_, scores, "text", rows=few)
    model = F.when((F.col("score") < threshold) & (F.col("text") != ""), F.lit("block")).otherwise(F.lit("allow"))
    out = decided.unionByName(open_).withColumn("verdict", F.coalesce("by_rule", model))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
