"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragweave.llm import hardneg, jpeg, linededup, mixing, neardup, pieces, pii, quality, tokencount, toxicity, txlog, urls, warc
from ragweave.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {"op1_mixing": mixing.ORACLE, "op3_linededup": linededup.ORACLE, "op12_txlog": txlog.ORACLE, "op13_hardneg": hardneg.ORACLE}


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op2_urls(spark, sf_dir):
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


@_query
def op3_linededup(spark, sf_dir):
    """The lines that go from each document."""
    return linededup.report(table(spark, sf_dir, "documents"))


@_query
def op4_jpeg(spark, sf_dir):
    """Features read back from the stored form of each text."""
    return jpeg.report(table(spark, sf_dir, "documents"))


@_query
def op5_pii(spark, sf_dir):
    """Personal data in each text."""
    return pii.report(table(spark, sf_dir, "documents"))


@_query
def op6_neardup(spark, sf_dir):
    """The near-duplicate class of each document."""
    return neardup.report(table(spark, sf_dir, "documents"))


@_query
def op7_warc(spark, sf_dir):
    """What each not-modified revisit of the pages' crawl log stands for."""
    return warc.report(table(spark, sf_dir, "pages"))


@_query
def op8_pieces(spark, sf_dir):
    """Digests of each text's ids and of what they decode to."""
    return pieces.report(table(spark, sf_dir, "documents"))


@_query
def op9_tokencount(spark, sf_dir):
    """Bytes and tokens of each text."""
    return tokencount.report(table(spark, sf_dir, "documents"))


@_query
def op10_quality(spark, sf_dir):
    """Base statistics and verdict of each document."""
    return quality.judge(table(spark, sf_dir, "documents"))


@_query
def op11_toxicity(spark, sf_dir):
    """The toxicity score of each document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op12_txlog(spark, sf_dir):
    """The store after each epoch of the documents' log, and its undone changes."""
    return txlog.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_hardneg(spark, sf_dir):
    """Hard negatives of every anchor and positive."""
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


#: What a contract fixes besides an operator's own method, as queries of their own that SQL can express.
ORACLES["url_rules"] = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(kind, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS by_rule FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, by_rule FROM u LEFT JOIN fits USING (page_id)"""
ORACLES["quality_base"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS gram FROM d, range(1, 100000) r(i) WHERE i <= len(w) - 4),
twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM twice GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN rep USING (doc_id)"""


@_query
def url_rules(spark, sf_dir):
    """Host, path and the longest rule of every url, before the method judges what no rule fits."""
    host, path = urls.host_path(F.col("url"))
    df = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urls.matched(F.col("host"), F.col("path"))
    return df.withColumns({"rule": rule, "by_rule": verdict})


@_query
def quality_base(spark, sf_dir):
    """The statistics and the base rule of every document, before the outlier test."""
    return quality.with_stats(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "__q.*")
