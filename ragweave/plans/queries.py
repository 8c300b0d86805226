"""The registered queries, each with the DuckDB statement for its rows where SQL can express them.

The tables stand in for passages (documents), questions (benchmark), vectors (embeddings, whose
vec_id is a doc_id), parallel arrays (conversations by turn) and measures (events).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.config import IngestConfig
from ragweave.functions import measures as M
from ragweave.functions import text as X
from ragweave.functions.session import settled, shared_dir, ship, stable_unions
from ragweave.operators import chunking, evaluation, guardrails, ingest, profiling, ranking, routing, table_functions
from ragweave.plans.answer import Answering
from ragweave.plans.registry import query
from ragweave.sources import catalog, shard_source, stores
from ragweave.sources.lexical import LAYOUT, LexicalStore
from ragweave.sources.seen import SeenKeys
from ragweave.sources.vectors import MAX_CELLS, VectorIndex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"), "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def lexical(spark: SparkSession, sf_dir: str) -> LexicalStore:
    """The lexical index of the documents in the shared folder; written first where these files have none."""
    stable_unions(spark)
    mark = stores.fingerprint(table(spark, sf_dir, "documents"))
    store = LexicalStore(spark, f"{shared_dir(spark)}/ragweave/lexical/{LAYOUT}-{mark}")
    if not store.segments():
        store.add(documents(spark, sf_dir))
    return store


# DuckDB fragments -----------------------------------------------------------------------------

_S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_N = r"[^\p{L}\p{N}\p{M}_]"
_NL = r"[^\p{L}\p{N}\p{M}_\n]"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'), ' ')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda t: replace(lower(t), 'ß', 'ss'))"


def _parts(x: str, marks: str) -> str:
    cut = f"regexp_replace({_strip(x)}, '([{marks}]){_S}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


_SENTENCES = _parts("text", ".!?।؟۔…")
_CLAIMS = _parts("text", ".!?।؟۔")
_KEY = f"replace(lower({_squeeze('text')}), 'ß', 'ss')"

_BM25 = f"""
tok AS (SELECT doc_id, lang, {_tokens('text')} AS t FROM documents WHERE {_strip('text')} <> ''),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok),
post AS (SELECT doc_id, lang, l, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
lex AS (SELECT query_id, doc_id, lang, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term), corpus GROUP BY ALL HAVING round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) > 0)"""


def _top(source: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source} WHERE {where} QUALIFY rank <= {k}"


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_NORM = "sqrt(list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"
_SCORES = {
    "cosine": f"{_DOT} / ({_NORM.format('q')} * {_NORM.format('v')})",
    "dot": _DOT,
    "euclid": "-list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
}


def _dense(metric: str, queries: str = "q.vec_id % 20 = 0", where: str = "true") -> str:
    return f"(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round({_SCORES[metric]}, 6) AS score FROM embeddings q, embeddings v WHERE {queries} AND {where})"


_HYBRID = f"""{_BM25},
dense AS ({_top(_dense('cosine', 'q.vec_id IN (SELECT item_id FROM benchmark)'), 20)}),
bm AS ({_top('lex', 20)}),
every AS (SELECT *, 0 AS list FROM dense UNION ALL SELECT *, 1 FROM bm),
fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf, min((list, rank)) AS seen, max(CASE WHEN list = 0 THEN score END) AS dense_score,
  max(CASE WHEN list = 1 THEN score END) AS bm25_score FROM every GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM fused QUALIFY rank <= 10)"""


# Text -----------------------------------------------------------------------------------------


@query("clean_text", f"""
SELECT doc_id, nullif({_squeeze('nfc_normalize(text)')}, '') AS clean,
  nullif({_squeeze("regexp_replace(" + _squeeze('nfc_normalize(text)') + ", '^[" + _S[1:-1] + ".,;:!?—–*#>)(-]+', '')")}, '') AS bare FROM documents""")
def clean_text(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.cleaned(F.col("text"), compose=True).alias("clean"), X.cleaned(F.col("text"), leading=True, compose=True).alias("bare"))


def _first_sql(by: str) -> str:
    return f"SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY doc_id) AS n FROM documents) WHERE n = 1"


@query("dedupe_key_global", _first_sql(f"lang, {_KEY}"))
def dedupe_key_global(spark, sf_dir):
    return ingest.first_passages(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "language")


@query("dedupe_key_per_lang", _first_sql(f"lang, source, {_KEY}"))
def dedupe_key_per_lang(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("shard_lang", F.col("source"))
    return ingest.first_passages(d, ["doc_id"], "per_lang").select("doc_id", "language")


@query("token_stats", f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_terms FROM documents")
def token_stats(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("vocab_df", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM documents) GROUP BY term")
def vocab_df(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("sentence_split", f"SELECT doc_id, i - 1 AS i, s[i] AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents), range(1, 100000) r(i) WHERE i <= len(s)")
def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


@query("claim_split", f"SELECT conv_id, turn, len({_CLAIMS}) AS n_claims, {_CLAIMS}[1] AS first_claim FROM conversations")
def claim_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.claims(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("n_claims"), F.get("c", F.lit(0)).alias("first_claim"))


@query("language_by_script", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\p{L}') THEN 'en' ELSE 'und' END AS script_language FROM documents")
def language_by_script(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.script_language(F.col("text")).alias("script_language"))


@query("point_id_uuid5", """
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  ['8','9','a','b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('7c3f1a904d2e5b68a1c49e0d8f7b6a52') || encode(doc_id || ':0:en:structure:0')) AS h FROM documents)""")
def point_id_uuid5(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.name_uuid(F.concat(F.col("doc_id").cast("string"), F.lit(":0:en:structure:0"))).alias("point_id"))


@query("cache_keys", "SELECT doc_id, sha256('m' || chr(0) || 'passage: ' || text) AS cache_key FROM documents")
def cache_keys(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.cache_key("m", X.prefixed(F.col("text"), "passage")).alias("cache_key"))


# Ingestion ------------------------------------------------------------------------------------


def _lists(spark, sf_dir) -> DataFrame:
    """Parallel arrays by conversation: what each role said, and a flag for each turn."""
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    flags = F.transform(F.sort_array(F.collect_list("turn")), lambda t: (t % 3 == 1).cast("int").cast("string"))
    return c.groupBy("conv_id").agg(said("user").alias("en"), said("assistant").alias("tr"), flags.alias("sel"))


_LISTS = """lists AS (SELECT conv_id, coalesce(list(text ORDER BY turn, text) FILTER (role = 'user'), []) AS en, coalesce(list(text ORDER BY turn, text) FILTER (role = 'assistant'), []) AS tr,
  list(turn % 3 = 1 ORDER BY turn) AS sel FROM conversations GROUP BY conv_id),
n AS (SELECT *, CASE WHEN least(len(en), len(tr), len(sel)) > 0 THEN least(len(en), len(tr), len(sel)) ELSE greatest(len(en), len(tr), len(sel)) END AS n FROM lists),
rows AS (SELECT conv_id, i - 1 AS i, en[i] AS en, tr[i] AS tr, coalesce(sel[i], false) AS selected FROM n, range(1, 10000) r(i) WHERE i <= n)"""


@query("align_zip_explode", f"WITH {_LISTS} SELECT * FROM rows")
def align_zip_explode(spark, sf_dir):
    rows = _lists(spark, sf_dir).select("conv_id", F.inline(ingest.aligned(F.col("en"), F.col("tr"), F.col("sel"))))
    return rows.withColumn("i", F.col("i").cast("long"))


def raw_examples(spark, sf_dir) -> DataFrame:
    """Raw nested rows made of conversations, under the source's schema."""
    lists = _lists(spark, sf_dir)
    shard = F.when(F.col("conv_id") % 2 == 0, "hi").otherwise("ta")
    meta = F.lit(None).cast(catalog.META)
    passages = F.struct(F.col("en").alias("English_passages"), F.col("tr").alias("Translated_passages"), F.col("sel").alias("is_selected"))
    return lists.select(
        F.lit("eng_Latn").alias("source_lang"), F.lit("").alias("target_lang"), meta.alias("meta"), F.get("tr", F.lit(0)).alias("Answer"),
        F.when(F.col("conv_id") % 11 == 0, "none").otherwise(F.col("conv_id").cast("string")).alias("query_id"),
        F.when(F.col("conv_id") % 3 == 0, "DESCRIPTION").otherwise("").alias("query_type"), passages.alias("passages"),
        F.concat(F.lit(". "), F.get("en", F.lit(0))).alias("Eng_Query"), F.lit("").alias("Eng_Answer"), F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(F.get("tr", F.lit(0))).alias("query"),
        shard.alias("shard_lang"), F.lit("validation").alias("split"),
    )


_PASSAGES = f"""{_LISTS}, p AS (
SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN 'hi' ELSE 'ta' END AS shard_lang, i AS passage_index, selected, nullif({_squeeze('nfc_normalize(en)')}, '') AS t1, nullif({_squeeze('nfc_normalize(tr)')}, '') AS t2 FROM rows WHERE conv_id % 11 <> 0),
passages AS (SELECT query_id, shard_lang, passage_index, 'en' AS language, 'english' AS passage_source, t1 AS text, selected FROM p WHERE t1 IS NOT NULL
UNION ALL SELECT query_id, shard_lang, passage_index, shard_lang, 'translated', t2, selected FROM p WHERE t2 IS NOT NULL)"""


@query("passage_explode", f"""WITH {_PASSAGES} SELECT query_id || ':' || passage_index || ':' || language AS document_id, query_id, CAST(passage_index AS INT) AS passage_index, text, language, passage_source,
  selected AS is_selected, CAST(length(text) AS INT) AS char_length, shard_lang FROM passages""")
def passage_explode(spark, sf_dir):
    rows = ingest.exploded(ingest.examples(raw_examples(spark, sf_dir)))
    return rows.select("document_id", "query_id", "passage_index", "text", "language", "passage_source", "is_selected", "char_length", "shard_lang")


@query("ingest_counts", f"""WITH {_PASSAGES}, ex AS (SELECT conv_id AS query_id FROM lists WHERE conv_id % 11 <> 0),
per AS (SELECT ex.query_id, count(p.query_id) AS k, count(*) FILTER (p.selected) AS g, coalesce(sum(length(p.text)), 0) AS c FROM ex LEFT JOIN passages p USING (query_id) GROUP BY 1)
SELECT count(*) AS examples, CAST(sum(k) AS BIGINT) AS passages, CAST(sum(g) AS BIGINT) AS gold_passages, count(*) FILTER (g = 0) AS without_gold,
  (SELECT count(*) FROM lists WHERE conv_id % 11 <> 0 AND nullif({_squeeze('tr[1]')}, '') IS NULL) AS without_answer,
  round(sum(k) / count(*), 2) AS passages_per_example, round(sum(c) / sum(k), 2) AS chars_per_passage FROM per""")
def ingest_counts(spark, sf_dir):
    return ingest.counts(ingest.examples(raw_examples(spark, sf_dir), IngestConfig(skip_empty_queries=False)))


@query("ingest_report", f"""WITH {_PASSAGES}, ex AS (SELECT conv_id AS query_id, {_squeeze('nfc_normalize(tr[1])')} AS answer, CASE WHEN conv_id % 5 = 0 THEN '' ELSE coalesce({_squeeze('nfc_normalize(tr[1])')}, '') END AS native,
  coalesce({_squeeze("regexp_replace(" + _squeeze("nfc_normalize('. ' || en[1])") + ", '^[" + _S[1:-1] + ".,;:!?—–*#>)(-]+', '')")}, '') AS eng FROM lists WHERE conv_id % 11 <> 0),
good AS (SELECT * FROM ex WHERE native <> '' OR eng <> ''),
k AS (SELECT p.*, row_number() OVER (PARTITION BY language, replace(lower(text), 'ß', 'ss') ORDER BY shard_lang, query_id, passage_index, passage_source) AS n FROM passages p JOIN good USING (query_id)),
per AS (SELECT good.query_id, count(k.query_id) FILTER (n = 1) AS kept, coalesce(sum(length(text)) FILTER (n = 1), 0) AS chars FROM good LEFT JOIN k USING (query_id) GROUP BY 1)
SELECT (SELECT count(*) FROM lists) AS records_processed, (SELECT count(*) FROM lists) - count(*) AS records_skipped, (SELECT count(*) FROM lists WHERE conv_id % 11 = 0) AS unusable_ids, (SELECT count(*) FROM ex) - count(*) AS empty_queries, CAST(0 AS BIGINT) AS without_any_answer,
  count(*) AS records_emitted, count(*) FILTER (coalesce(answer, '') = '') AS empty_answers, count(*) AS empty_eng_answers, (SELECT count(*) FROM k WHERE n > 1) AS passages_deduped, count(*) FILTER (kept = 0) AS without_passages,
  CAST(sum(kept) AS BIGINT) AS passages_emitted, CAST(sum(length(native) + length(eng)) AS BIGINT) AS query_chars, CAST(sum(chars) AS BIGINT) AS passage_chars FROM good JOIN per USING (query_id)""")
def ingest_report(spark, sf_dir):
    """What an ingest run with global passage dedup saw, left out and gave."""
    return ingest.report(raw_examples(spark, sf_dir), IngestConfig(dedupe=True))


@query("ingest_distributions", f"""WITH {_LISTS}, ex AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'hi' ELSE 'ta' END AS lang, CASE WHEN conv_id % 3 = 0 THEN 'DESCRIPTION' END AS kind FROM lists WHERE conv_id % 11 <> 0)
SELECT 'language' AS dimension, lang AS value, count(*) AS n FROM ex GROUP BY 2 UNION ALL SELECT 'flores_target', lang, count(*) FROM ex GROUP BY 2 UNION ALL SELECT 'query_type', kind, count(*) FROM ex WHERE kind IS NOT NULL GROUP BY 2""")
def ingest_distributions(spark, sf_dir):
    """Examples by language, target language and query type."""
    return ingest.distributions(ingest.examples(raw_examples(spark, sf_dir), IngestConfig(skip_empty_queries=False)))


@query("ingest_deduped", f"""WITH {_PASSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY language, replace(lower(text), 'ß', 'ss') ORDER BY shard_lang, query_id, passage_index, passage_source) AS n FROM passages)
SELECT query_id, count(*) AS kept, count(*) FILTER (selected) AS gold FROM k WHERE n = 1 GROUP BY query_id""")
def ingest_deduped(spark, sf_dir):
    df = ingest.deduped(ingest.examples(raw_examples(spark, sf_dir)))
    return df.where(F.size("passages") > 0).select("query_id", F.size("passages").cast("long").alias("kept"), F.size("gold_document_ids").cast("long").alias("gold"))


@query("ingest_repeated_ids", f"""WITH {_PASSAGES}, r AS (SELECT CAST(query_id AS BIGINT) // 4 AS qid, CASE WHEN query_id % 3 = 0 THEN 'train' ELSE 'validation' END AS split, * FROM passages),
k AS (SELECT *, row_number() OVER (PARTITION BY language, replace(lower(text), 'ß', 'ss') ORDER BY shard_lang, split, qid, (SELECT '. ' || en[1] FROM lists WHERE conv_id = r.query_id), query_id, passage_index, passage_source) AS n FROM r)
SELECT qid AS query_id, split, shard_lang, max(text) AS last_text, count(*) AS kept, count(*) FILTER (selected) AS gold FROM k WHERE n = 1 GROUP BY qid, split, shard_lang, k.query_id""")
def ingest_repeated_ids(spark, sf_dir):
    """Dedup of examples that share their ids, within a shard and across splits: each keeps its own passages."""
    raw = raw_examples(spark, sf_dir).where("query_id != 'none'").withColumns({"Eng_Query": F.coalesce("Eng_Query", F.lit("")), "split": F.when(F.col("query_id").cast("long") % 3 == 0, "train").otherwise("validation")})
    raw = raw.orderBy(F.col("query_id").cast("long")).withColumn("query_id", F.floor(F.col("query_id").cast("long") / 4).cast("string"))
    df = ingest.deduped(ingest.examples(raw, IngestConfig(skip_empty_queries=False))).where(F.size("passages") > 0)
    last = F.array_max(F.transform("passages", lambda p: p["text"]))
    return df.select("query_id", "split", "shard_lang", last.alias("last_text"), F.size("passages").cast("long").alias("kept"), F.size("gold_document_ids").cast("long").alias("gold"))


@query("ingest_shards", """SELECT lang AS shard_lang, doc_id AS query_id, text AS query, CAST(NULL AS VARCHAR) AS error FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 3 <> 0
UNION ALL SELECT 'xx', NULL, NULL, 'unreadable'""")
def ingest_shards(spark, sf_dir):
    """Validation shards of two languages and one that isn't there, read by the shard source with pushed filters."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.lit("q").alias("query_type"), "language", (F.col("doc_id") % 3 == 0).alias("train"))
    root = f"{shared_dir(spark)}/ragweave/shards/{uuid.uuid4().hex}"
    d.withColumn("split", F.when(F.col("train"), "train").otherwise("validation")).drop("train").write.partitionBy("split", "language").parquet(root)
    files = spark.read.parquet(root).select("_metadata.file_path", "split", "language").distinct().toDF("path", "split", "lang")
    found = shard_source.catalog_of(files)
    found.setdefault("validation", {})["xx"] = f"{root}/nowhere.parquet"
    rows = shard_source.read(spark, found).where("split = 'validation' and shard_lang in ('de', 'fr', 'xx')")
    return rows.select("shard_lang", F.col("query_id").cast("long").alias("query_id"), "query", F.when(F.col("error").isNotNull(), "unreadable").alias("error"))


@query("lang_histogram", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang")
def lang_histogram(spark, sf_dir):
    return ingest.histogram(documents(spark, sf_dir), "language", skip_blank=True)


@query("first_per_language", "SELECT doc_id, lang AS shard_lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50")
def first_per_language(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("language", "shard_lang")
    return ingest.per_language(d, IngestConfig().examples_per_language, ["doc_id"]).select("doc_id", "shard_lang")


# Chunking -------------------------------------------------------------------------------------


def _passages(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return chunking.passages(d.select(F.col("doc_id").alias("query_id"), "text", "language", (F.col("doc_id") % 10 == 0).alias("is_selected")))


def _chunks(spark, sf_dir, strategy: str) -> DataFrame:
    c = chunking.chunks(_passages(spark, sf_dir), strategy)
    return c.select("chunk_id", "document_id", "chunk_index", "start_sentence", "end_sentence", "text", "char_length", "sentence_count")


_SENT = f"sent AS (SELECT doc_id, doc_id || ':0:' || lang AS document_id, {_SENTENCES} AS s, doc_id % 10 = 0 AS is_selected FROM documents WHERE {_strip('text')} <> '')"
_CHUNK_COLUMNS = """document_id || ':{0}:' || chunk_index AS chunk_id, document_id, CAST(chunk_index AS INT) AS chunk_index, CAST(a AS INT) AS start_sentence, CAST(b AS INT) AS end_sentence,
  list_aggregate(s[a + 1 : b + 1], 'string_agg', ' ') AS text, CAST(length(list_aggregate(s[a + 1 : b + 1], 'string_agg', ' ')) AS INT) AS char_length, CAST(b - a + 1 AS INT) AS sentence_count"""
_SLIDING = """slid AS (SELECT document_id, is_selected, s, k AS chunk_index, 2 * k AS a, least(len(s) - 1, 2 * k + 3) AS b FROM sent, range(0, 100000) r(k) WHERE len(s) > 0 AND k <= greatest(CAST(ceil((len(s) - 4) / 2.0) AS INT), 0))"""
_STRUCTURE = """walk(document_id, is_selected, s, chunk_index, a, b) AS (
  SELECT document_id, is_selected, s, 0, 0, CASE WHEN len(s) > 1 AND length(s[1]) + 1 + length(s[2]) <= 420 THEN CASE WHEN len(s) > 2 AND length(s[1]) + length(s[2]) + length(s[3]) + 2 <= 420 THEN 2 ELSE 1 END ELSE 0 END FROM sent WHERE len(s) > 0
  UNION ALL
  SELECT document_id, is_selected, s, chunk_index + 1, x, CASE WHEN len(s) > x + 1 AND length(s[x + 1]) + 1 + length(s[x + 2]) <= 420 THEN CASE WHEN len(s) > x + 2 AND length(s[x + 1]) + length(s[x + 2]) + length(s[x + 3]) + 2 <= 420 THEN x + 2 ELSE x + 1 END ELSE x END
  FROM (SELECT *, greatest(b, a + 1) AS x FROM walk WHERE b < len(s) - 1))"""


@query("chunk_sliding", f"WITH {_SENT}, {_SLIDING} SELECT {_CHUNK_COLUMNS.format('sliding')} FROM slid")
def chunk_sliding(spark, sf_dir):
    return _chunks(spark, sf_dir, "sliding")


@query("chunk_structure", f"WITH RECURSIVE {_SENT}, {_STRUCTURE} SELECT {_CHUNK_COLUMNS.format('structure')} FROM walk")
def chunk_structure(spark, sf_dir):
    return _chunks(spark, sf_dir, "structure")


@query("chunk_lateral", f"WITH RECURSIVE {_SENT}, {_STRUCTURE} SELECT {_CHUNK_COLUMNS.format('structure')} FROM walk")
def chunk_lateral(spark, sf_dir):
    """The table function of the chunkers, beside each passage in SQL."""
    table_functions.register(spark, "ragweave_chunk")
    return spark.sql("""SELECT concat_ws(':', p.document_id, 'structure', c.chunk_index) AS chunk_id, p.document_id, c.chunk_index, c.start_sentence, c.end_sentence, c.text, c.char_length, c.sentence_count
        FROM {passages} p, LATERAL ragweave_chunk(p.text, 'structure') c""", passages=_passages(spark, sf_dir).select("document_id", "text"))


@query("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    return _chunks(spark, sf_dir, "semantic")


@query("chunk_adaptive")
def chunk_adaptive(spark, sf_dir):
    return _chunks(spark, sf_dir, "adaptive")


_LONG = "(len(s) >= 6 OR list_sum(list_transform(s, lambda x: length(x))) + len(s) - 1 >= 520)"


@query("adaptive_settled", f"""WITH {_SENT} SELECT document_id, CASE WHEN len(s) <= 1 OR list_sum(list_transform(s, lambda x: length(x))) + len(s) - 1 <= 160 THEN 'structure:short_passage'
  WHEN {_LONG} THEN 'sliding:long_passage' WHEN len(s) < 3 THEN 'structure:typical_multi_sentence' END AS reason FROM sent
WHERE len(s) <= 1 OR list_sum(list_transform(s, lambda x: length(x))) + len(s) - 1 <= 160 OR {_LONG} OR len(s) < 3""")
def adaptive_settled(spark, sf_dir):
    """The adaptive choice of the passages that need no vectors."""
    df = chunking.with_spans(_passages(spark, sf_dir), "adaptive").withColumn("n", F.size("sentences"))
    chars = F.aggregate(F.transform("sentences", F.length), F.lit(0), lambda a, x: a + x) + F.col("n") - 1
    return df.where((F.col("n") < 3) | (F.col("n") >= 6) | (chars <= 160) | (chars >= 520)).select("document_id", "reason")


@query("chunk_overlap_ratio", f"""WITH RECURSIVE {_SENT}, {_SLIDING}, {_STRUCTURE},
c AS (SELECT 'sliding' AS chunk_strategy, document_id, chunk_index, a, b FROM slid UNION ALL SELECT 'structure', document_id, chunk_index, a, b FROM walk),
p AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY chunk_strategy, document_id ORDER BY chunk_index)),
j AS (SELECT *, greatest(0, least(b, b2) - greatest(a, a2) + 1) AS i FROM p WHERE a2 IS NOT NULL)
SELECT chunk_strategy, count(*) AS pairs, round(avg(i / ((b - a + 1) + (b2 - a2 + 1) - i)), 4) AS overlap_ratio FROM j GROUP BY 1""")
def chunk_overlap_ratio(spark, sf_dir):
    p = _passages(spark, sf_dir)
    return evaluation.overlap_ratio(chunking.chunks(p, "sliding").unionByName(chunking.chunks(p, "structure")))


@query("chunk_metrics", f"""WITH RECURSIVE {_SENT}, {_SLIDING}, {_STRUCTURE},
c AS (SELECT 'sliding' AS chunk_strategy, document_id, is_selected, b - a + 1 AS k, length(list_aggregate(s[a + 1 : b + 1], 'string_agg', ' ')) AS n FROM slid
  UNION ALL SELECT 'structure', document_id, is_selected, b - a + 1, length(list_aggregate(s[a + 1 : b + 1], 'string_agg', ' ')) FROM walk),
d AS (SELECT chunk_strategy, document_id, count(*) AS k, bool_or(is_selected) AS g FROM c GROUP BY ALL),
e AS (SELECT chunk_strategy, round(avg(k), 3) AS chunks_per_passage, round(quantile_cont(k, 0.5), 3) AS median_chunks, count(*) AS docs, count(*) FILTER (g) AS gold FROM d GROUP BY 1),
t AS (SELECT count(*) AS n, count(*) FILTER (is_selected) AS gold FROM sent)
SELECT c.chunk_strategy, count(*) AS chunks, round(avg(n), 2) AS avg_chars, round(quantile_cont(n, 0.5), 3) AS median_chars, CAST(min(n) AS INT) AS min_chars, CAST(max(n) AS INT) AS max_chars,
  CAST(list_sort(list(n))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS INT) AS p90_chars, round(avg(c.k), 3) AS avg_sentences, round(quantile_cont(c.k, 0.5), 3) AS median_sentences, CAST(min(c.k) AS INT) AS min_sentences, CAST(max(c.k) AS INT) AS max_sentences, any_value(e.chunks_per_passage) AS chunks_per_passage, any_value(e.median_chunks) AS median_chunks,
  any_value((SELECT n FROM t) - e.docs) AS zero_chunk_passages, any_value(round(100.0 * e.gold / (SELECT gold FROM t), 2)) AS gold_coverage_pct
FROM c JOIN e USING (chunk_strategy) GROUP BY 1""")
def chunk_metrics(spark, sf_dir):
    p = _passages(spark, sf_dir)
    return evaluation.chunk_metrics(chunking.chunks(p, "sliding").unionByName(chunking.chunks(p, "structure")), p)


# Ranking --------------------------------------------------------------------------------------


@query("bm25_topk", f"WITH {_BM25} {_top('lex', 10)}")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).search(questions(spark, sf_dir), 10)


@query("bm25_topk_filtered", f"WITH {_BM25} {_top('lex', 10, chr(39).join(['lang IN (', 'de', ',', 'fr', ')']))}")
def bm25_topk_filtered(spark, sf_dir):
    d = documents(spark, sf_dir)
    return lexical(spark, sf_dir).search(questions(spark, sf_dir), 10, d.where(F.col("language").isin("de", "fr")))


_FINAL = "SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 1 THEN text || ' ' || reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3"


@query("bm25_grown", f"WITH base AS ({_FINAL}), {_BM25.replace('FROM documents', 'FROM base')} {_top('lex', 10)}")
def bm25_grown(spark, sf_dir):
    """The same search over an index that grew in batches: two halves, replaced documents, deleted ones."""
    d, path = documents(spark, sf_dir), f"{shared_dir(spark)}/ragweave/lexical/{uuid.uuid4().hex}"
    store = LexicalStore(spark, path)
    for batch in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 != 0"), d.where("doc_id % 5 = 1").withColumn("text", F.concat("text", F.lit(" "), F.reverse("text")))):
        store.add(batch)
    store.delete(d.where("doc_id % 7 = 3"))
    return store.search(questions(spark, sf_dir), 10)


def _dense_query(metric: str, where: str | None = None):
    def build(spark, sf_dir):
        v = vectors(spark, sf_dir)
        asked = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
        return ranking.dense_search(v, asked, 10, metric, F.expr(where) if where else None)

    return build


for _metric in _SCORES:
    query(f"dense_topk_{_metric}", _top(_dense(_metric), 10))(_dense_query(_metric))
query("dense_topk_filtered", _top(_dense("cosine", where="v.label IN (1, 3)"), 10))(_dense_query("cosine", "label IN (1, 3)"))


@query("dense_topk_cells", _top(_dense("cosine"), 10))
def dense_topk_cells(spark, sf_dir):
    """The same search through the cell index, with every cell probed: each row is found in its cell."""
    v = vectors(spark, sf_dir)
    index = VectorIndex(spark, f"{shared_dir(spark)}/ragweave/vectors/{uuid.uuid4().hex}")
    index.build(v)
    return index.search(v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10, probes=MAX_CELLS)


def hybrid_lists(spark, sf_dir, asked: DataFrame, k: int) -> list[tuple[str, DataFrame]]:
    """Ranked lists of questions: by the vector of the question's id, and by words."""
    v = vectors(spark, sf_dir)
    asked_vectors = v.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "query_id")
    return [("dense", ranking.dense_search(v, asked_vectors, k)), ("bm25", lexical(spark, sf_dir).search(asked, k))]


def _hybrid(spark, sf_dir) -> DataFrame:
    return ranking.fuse(hybrid_lists(spark, sf_dir, questions(spark, sf_dir), 20))


@query("rrf_hybrid", f"WITH {_HYBRID} SELECT query_id, doc_id, round(rrf, 6) AS rrf, dense_score, bm25_score, rank FROM hits")
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "dense_score", "bm25_score", "rank")


_SIGNALS = "sig AS (SELECT query_id, max(rrf) AS top, max(rrf) - coalesce(max(rrf) FILTER (rank = 2), 0) AS gap, count(*) FILTER (rrf >= 0.018) AS n_strong FROM hits GROUP BY 1)"


@query("rerank_signals", f"WITH {_HYBRID}, {_SIGNALS} SELECT query_id, round(top, 6) AS top, round(gap, 6) AS gap, CAST(n_strong AS INT) AS n_strong FROM sig")
def rerank_signals(spark, sf_dir):
    s = ranking.signals(_hybrid(spark, sf_dir))
    return s.select("query_id", F.round("top", 6).alias("top"), F.round("gap", 6).alias("gap"), "n_strong")


@query("lexical_rerank", f"""WITH {_HYBRID}, r AS (SELECT h.query_id, h.doc_id, h.rank AS old, round(len(list_intersect(list_distinct({_tokens('b.text')}), list_distinct({_tokens('d.text')}))) / len(list_distinct({_tokens('b.text')})), 6) AS rerank_score
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM r""")
def lexical_rerank(spark, sf_dir):
    hits = ranking.beside(documents(spark, sf_dir).select("doc_id", "text"), settled(_hybrid(spark, sf_dir)), "doc_id")  # ten a question
    hits = ranking.beside(hits, questions(spark, sf_dir).withColumnRenamed("text", "query"), "query_id", text="query")
    return ranking.rerank_lexical(hits, 12).select("query_id", "doc_id", "rerank_score", "rank")


# Routing --------------------------------------------------------------------------------------


def _word(*words: str) -> str:
    return f"regexp_matches(q, '(?i)(^|{_N})({'|'.join(words)})($|{_N})')"


_FEATURES = rf"""
q0 AS (SELECT conv_id, turn, {_strip('text')} AS q FROM conversations),
q1 AS (SELECT *, CAST(length(q) AS INT) AS n_chars, CAST(len({_tokens('q')}) AS INT) AS n_tokens,
  CAST(CASE WHEN q = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(q, '[;?]|(?:\s+and\s+)|(?:\s+then\s+)|(?:\s*,\s+)'), lambda p: {_strip('p')} <> ''))) END AS INT) AS n_clauses,
  CAST(greatest(length(regexp_replace(q, '[^?؟।]', '', 'g')), CASE WHEN q LIKE '%?' OR q LIKE '%؟' THEN 1 ELSE 0 END) AS INT) AS n_questions,
  {_word('compare', 'comparison', 'versus', r'vs\.?', 'differ', 'difference', 'differences', 'better', 'worse', 'trade-?off')} AS comparison,
  {_word('why', 'how', 'explain', 'describe', 'because', 'mechanism', 'process', 'formed', 'works?')} AS explanation,
  {_word('what', 'who', 'when', 'where', 'which', 'capital', 'define', 'definition', 'meaning')} AS factual,
  {_word('or', 'either', 'maybe', 'possibly', 'unclear', 'depends', 'might', 'could')} AS ambig,
  regexp_matches(q, '(?i)(^|{_N})(and (then|which|when)|first({_NL}|{_NL}.*{_NL})second|also({_NL}|{_NL}.*{_NL})and)($|{_N})|\p{{Nd}}\.{_S}') AS multi FROM q0),
q2 AS (SELECT *, ambig AND n_tokens >= 6 AS ambiguity, multi OR n_questions >= 2 OR n_clauses >= 3 AS multi_part FROM q1),
feat AS (SELECT *, CASE WHEN multi_part THEN 'multi_part' WHEN comparison THEN 'comparison' WHEN explanation THEN 'explanation' WHEN factual OR q LIKE '%?' OR q LIKE '%؟' THEN 'factual' ELSE 'other' END AS query_type,
  CASE WHEN q <> '' AND (n_clauses >= 3 OR n_questions >= 2 OR (multi_part AND n_tokens >= 14) OR (comparison AND explanation AND n_clauses >= 2) OR (n_tokens >= 22 AND (comparison OR explanation OR ambiguity)) OR (ambiguity AND explanation)) THEN 'DEEP'
    WHEN q <> '' AND (explanation OR comparison OR n_clauses >= 2 OR n_tokens > 12 OR n_chars > 90 OR ambiguity) THEN 'ACCURATE' ELSE 'FAST' END AS route FROM q2)"""


def _features(spark, sf_dir) -> DataFrame:
    return routing.features(table(spark, sf_dir, "conversations"))


@query("query_features", f"WITH {_FEATURES} SELECT conv_id, turn, n_chars, n_tokens, n_clauses, n_questions, comparison, explanation, factual, ambiguity, multi_part FROM feat")
def query_features(spark, sf_dir):
    return _features(spark, sf_dir).select("conv_id", "turn", "n_chars", "n_tokens", "n_clauses", "n_questions", "comparison", "explanation", "factual", "ambiguity", "multi_part")


@query("query_route", f"WITH {_FEATURES} SELECT conv_id, turn, query_type, route, CASE route WHEN 'DEEP' THEN 'complex' WHEN 'ACCURATE' THEN 'moderate' ELSE 'simple' END AS complexity FROM feat")
def query_route(spark, sf_dir):
    return _features(spark, sf_dir).select("conv_id", "turn", "query_type", "route", "complexity")


_ENTITIES = r"""SELECT conv_id, turn, CAST(len(list_distinct(list_concat(
  list_transform(list_filter(string_split(regexp_replace(regexp_replace(q, '([\p{L}\p{N}\p{M}_]+)', chr(1) || '\1' || chr(2), 'g'), '\x01([A-Z][a-zA-Z]{2,})\x02((\s+\x01[A-Z][a-zA-Z]{2,}\x02)*)', chr(3) || chr(4) || '\1\2' || chr(3), 'g'), chr(3)), lambda x: x LIKE chr(4) || '%'), lambda x: regexp_replace(x, '[\x01\x02\x04]', '', 'g')),
  list_filter(list_transform(regexp_extract_all(q, '["“”'']([^"“”'']+)["“”'']', 1), lambda x: trim(x)), lambda x: x <> '')))) AS INT) AS n_entities,
  CASE WHEN regexp_matches(q, '\p{L}') THEN 'en' ELSE 'und' END AS language FROM (SELECT conv_id, turn, text AS q FROM conversations)"""


@query("query_entities", _ENTITIES)
def query_entities(spark, sf_dir):
    return _features(spark, sf_dir).select("conv_id", "turn", "n_entities", "language")


@query("route_distribution", f"""WITH {_FEATURES}, c AS (SELECT route, count(*) AS n FROM feat GROUP BY 1)
SELECT r.route, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c), 2) AS pct FROM (VALUES ('FAST'), ('ACCURATE'), ('DEEP')) r(route) LEFT JOIN c USING (route)""")
def route_distribution(spark, sf_dir):
    counted = _features(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))
    every = ranking.route_plans(spark).select("route").join(counted, "route", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = every.agg(F.sum("n").alias("t"))
    return every.join(F.broadcast(total), F.lit(True)).select("route", "n", F.round(100.0 * F.col("n") / F.nullif("t", F.lit(0)), 2).alias("pct"))


@query("route_examples", f"WITH {_FEATURES} SELECT route, conv_id, turn FROM feat QUALIFY row_number() OVER (PARTITION BY route ORDER BY conv_id, turn) <= 3")
def route_examples(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("route").orderBy("conv_id", "turn")
    return _features(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 3").select("route", "conv_id", "turn")


_BENCH_FEATURES = _FEATURES.replace("conv_id, turn", "item_id").replace("FROM conversations", "FROM benchmark")


_DECIDED = """s AS (SELECT f.item_id AS query_id, f.route, coalesce(top, 0) AS top, coalesce(gap, 0) AS gap, coalesce(n_strong, 0) AS n_strong FROM feat f LEFT JOIN sig ON sig.query_id = f.item_id),
d AS (SELECT *, CASE WHEN route = 'FAST' THEN 'route_fast' WHEN route = 'DEEP' AND top >= 0.04 AND (gap >= 0.006 OR n_strong <= 1) THEN 'hybrid confidence was sufficient'
  WHEN route = 'ACCURATE' AND top >= 0.028 AND NOT (gap < 0.006 AND n_strong > 1) AND n_strong <= 2 THEN 'hybrid confidence was sufficient' END AS skip FROM s)"""


@query("rerank_decision", f"""WITH {_HYBRID}, {_SIGNALS}, {_BENCH_FEATURES}, {_DECIDED}
SELECT query_id, route, route <> 'FAST' AS requested, skip IS NULL AS applied, coalesce(skip, CASE WHEN route = 'DEEP' THEN 'DEEP and hybrid ranking is not uniquely strong' ELSE 'hybrid ranking is ambiguous' END) AS reason FROM d""")
def rerank_decision(spark, sf_dir):
    asked = routing.features(questions(spark, sf_dir))
    return ranking.decisions(asked.join(ranking.signals(_hybrid(spark, sf_dir)), "query_id", "left")).select("query_id", "route", "requested", "applied", "reason")


# Guardrails -----------------------------------------------------------------------------------


def _hits(spark, sf_dir) -> DataFrame:
    h = ranking.beside(documents(spark, sf_dir).select("doc_id", "text", "language"), settled(_hybrid(spark, sf_dir)), "doc_id")  # ten a question
    return h.withColumn("score", F.col("rrf"))


@query("sufficiency_gate", f"""WITH {_HYBRID}, o AS (SELECT h.query_id, max(h.rrf) AS top, count(*) FILTER (d.lang <> '') AS known, count(*) FILTER (d.lang = 'en') AS own,
  max(len(list_intersect(list_distinct({_tokens('b.text')}), list_distinct({_tokens('d.text')}))) / len(list_distinct({_tokens('b.text')}))) AS overlap
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id) GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN top IS NULL THEN 'no_hits' WHEN top < 0.012 THEN 'low_score' WHEN known > 0 AND own = 0 THEN 'ok_cross_lingual' WHEN overlap < 0.04 THEN 'low_lexical_overlap' ELSE 'ok' END AS gate_reason,
  coalesce(top >= 0.012 AND ((known > 0 AND own = 0) OR overlap >= 0.04), false) AS sufficient FROM benchmark LEFT JOIN o ON o.query_id = item_id""")
def sufficiency_gate(spark, sf_dir):
    asked = questions(spark, sf_dir).withColumn("language", X.script_language(F.col("text")))
    return guardrails.gate(asked, _hits(spark, sf_dir)).select("query_id", "gate_reason", "sufficient")


_PACK = f"""{_HYBRID},
h AS (SELECT query_id, rank, doc_id, {_strip('d.text')} AS x, list_distinct({_tokens('d.text')}) AS t FROM hits JOIN documents d USING (doc_id) WHERE {_strip('d.text')} <> ''),
n AS (SELECT query_id, doc_id, x, t, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h),
pack(query_id, i, ids, kept, chars, dropped, truncated) AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[][]), CAST(0 AS BIGINT), 0, false FROM n
  UNION ALL
  SELECT query_id, i, CASE WHEN take THEN list_append(ids, CAST(doc_id AS VARCHAR)) ELSE ids END, CASE WHEN take THEN list_append(kept, t) ELSE kept END, CASE WHEN take THEN chars + length(x) ELSE chars END,
    dropped + CASE WHEN NOT truncated AND same THEN 1 ELSE 0 END, truncated OR (NOT same AND full_)
  FROM (SELECT *, NOT truncated AND NOT same AND NOT full_ AS take FROM (
    SELECT p.query_id, n.i, p.ids, p.kept, p.chars, p.dropped, p.truncated, n.doc_id, n.x, n.t,
      len(list_filter(p.kept, lambda k: len(k) > 0 AND len(n.t) > 0 AND len(list_intersect(k, n.t)) / (len(k) + len(n.t) - len(list_intersect(k, n.t))) >= 0.85)) > 0 AS same,
      len(p.ids) >= 5 OR (p.chars + length(n.x) > 3500 AND len(p.ids) > 0) AS full_
    FROM pack p JOIN n ON n.query_id = p.query_id AND n.i = p.i + 1)))"""


@query("evidence_pack", f"WITH RECURSIVE {_PACK} SELECT query_id, array_to_string(ids, ',') AS doc_ids, dropped, truncated FROM pack QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1")
def evidence_pack(spark, sf_dir):
    e = guardrails.evidence(_hits(spark, sf_dir))
    return e.select("query_id", F.array_join(F.transform("items", lambda k: k["doc_id"].cast("string")), ",").alias("doc_ids"), "dropped", "truncated")


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _content(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda t: NOT list_contains([{_STOP}], t) AND NOT regexp_matches(t, '^[\\p{{Nd}}²³¹]+$')))"


@query("grounding_verdicts", f"""WITH a AS (SELECT c.conv_id, c.turn, {_CLAIMS.replace('text', 'c.text')} AS claims, {_content('d.text')} AS ev FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
u AS (SELECT conv_id, turn, i - 1 AS i, claims[i] AS claim, ev FROM a, range(1, 1000) r(i) WHERE i <= len(claims)),
o AS (SELECT *, round(CASE WHEN len(ev) > 0 AND len({_content('claim')}) > 0 THEN len(list_intersect({_content('claim')}, ev)) / len({_content('claim')}) ELSE 0.0 END, 6) AS overlap FROM u)
SELECT conv_id, turn, i, claim, overlap, CASE WHEN overlap >= 0.12 THEN 'supported' WHEN overlap >= 0.06 THEN 'uncertain' ELSE 'unsupported' END AS label FROM o""")
def grounding_verdicts(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), X.content_tokens(F.col("text")).alias("ev"))
    c = table(spark, sf_dir, "conversations").join(d, "conv_id").select("conv_id", "turn", "ev", X.claims(F.col("text")).alias("claims"))
    rows = c.select("conv_id", "turn", F.posexplode(guardrails.verdicts(F.col("claims"), F.col("ev"), 0.12)).alias("i", "v"))
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "v.claim", "v.overlap", "v.label")


@query("json_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'grounded' AS status, event_type AS answer, [user_id || ':0', 'x'] AS sources FROM events")
def json_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("answer"), F.lit("fine").alias("status"), F.array(F.to_json(F.struct(F.concat(F.col("user_id").cast("string"), F.lit(":0")).alias("chunk_id")))).alias("s")))
    body = F.regexp_replace(F.regexp_replace(F.replace(body, F.lit('"s":["'), F.lit('"sources":["x",')), r'\\"', '"'), r'\}"\]', "}]")
    out = e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), guardrails.parsed(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("p"))
    return out.select("event_id", "k", "p.status", "p.answer", F.reverse("p.sources").alias("sources"))


@query("answer_plan")
def answer_plan(spark, sf_dir):
    """The whole dataflow for every benchmark question and a blank one."""
    asked = questions(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "  ")], "query_id long, text string"))
    plan = Answering(documents(spark, sf_dir), lambda q, k: hybrid_lists(spark, sf_dir, q, k))
    return plan.run(asked)


# Evaluation -----------------------------------------------------------------------------------


def _gold(spark, sf_dir) -> DataFrame:
    """Documents that hold a question's text are its gold."""
    return evaluation.holding(documents(spark, sf_dir), questions(spark, sf_dir))


_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_PER = f"""{_BM25}, ranked AS ({_top('lex', 10)}), {_GOLD},
m AS (SELECT r.*, g.doc_id IS NOT NULL AS g FROM ranked r LEFT JOIN gold g USING (query_id, doc_id)),
f AS (SELECT query_id, max(CASE WHEN g AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS r1, max(CASE WHEN g AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS r5, max(CASE WHEN g THEN 1.0 ELSE 0.0 END) AS r10, coalesce(1.0 / min(CASE WHEN g THEN rank END), 0.0) AS mrr FROM m GROUP BY 1),
per AS (SELECT item_id AS query_id, length(text) AS lat, CASE WHEN h THEN CAST(coalesce(r1, 0) AS DOUBLE) END AS r1, CASE WHEN h THEN CAST(coalesce(r5, 0) AS DOUBLE) END AS r5, CASE WHEN h THEN CAST(coalesce(r10, 0) AS DOUBLE) END AS r10, CASE WHEN h THEN CAST(coalesce(mrr, 0) AS DOUBLE) END AS mrr
  FROM (SELECT *, item_id IN (SELECT query_id FROM gold) AS h FROM benchmark) LEFT JOIN f ON f.query_id = item_id)"""


def _per_query(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir)
    return evaluation.per_query(bm25_topk(spark, sf_dir), settled(_gold(spark, sf_dir)), q)


@query("recall_mrr", f"WITH {_PER} SELECT query_id, r1, r5, r10, round(mrr, 6) AS mrr FROM per")
def recall_mrr(spark, sf_dir):
    return _per_query(spark, sf_dir).select("query_id", "r1", "r5", "r10", F.round("mrr", 6).alias("mrr"))


@query("metric_breakdown", f"""WITH {_PER}, {_BENCH_FEATURES}, e AS (SELECT per.*, feat.route, feat.query_type, CASE feat.route WHEN 'DEEP' THEN 'complex' WHEN 'ACCURATE' THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN regexp_matches(feat.q, '\\p{{L}}') THEN 'en' ELSE 'und' END AS language FROM per JOIN feat ON feat.item_id = per.query_id),
u AS (SELECT 'all' AS dimension, 'all' AS value, * FROM e UNION ALL SELECT 'route', route, * FROM e UNION ALL SELECT 'query_type', query_type, * FROM e
  UNION ALL SELECT 'complexity', complexity, * FROM e UNION ALL SELECT 'language', language, * FROM e)
SELECT dimension, value, count(r10) AS n, round(avg(r1), 4) AS recall_at_1, round(avg(r5), 4) AS recall_at_5, round(avg(r10), 4) AS recall_at_10, round(avg(mrr), 4) AS mrr,
  round(avg(lat), 3) AS lat_mean, round(quantile_cont(lat, 0.5), 3) AS lat_p50, round(quantile_cont(lat, 0.7), 3) AS lat_p70, CAST(max(lat) AS DOUBLE) AS lat_p100 FROM u GROUP BY 1, 2""")
def metric_breakdown(spark, sf_dir):
    rows = settled(routing.features(_per_query(spark, sf_dir)))  # a row a question, read by each pass for percentiles
    return evaluation.breakdowns(rows, ["route", "query_type", "complexity", "language"], "n_chars")


@query("latency_summary", """SELECT event_type, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.7), 3) AS p70, round(max(value), 3) AS p100 FROM events GROUP BY 1""")
def latency_summary(spark, sf_dir):
    return M.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("nearest_rank_p90", "SELECT lang AS language, list_sort(list(n_chars))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90 FROM documents GROUP BY lang")
def nearest_rank_p90(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "n_chars")
    return M.at_indexes(rows, ["language"], {"p90": ("n_chars", M.nearest(90))}).withColumn("p90", F.col("p90").cast("long"))


def _index_sql(c: str) -> str:
    at = lambda s: f"CAST(list_sort(list({c}))[least(CAST(floor(count(*) * {s}) AS INT), count(*) - 1) + 1] AS DOUBLE)"
    return f"CAST(min({c}) AS DOUBLE) AS {c}_min, {at(0.5)} AS {c}_p50, {at(0.9)} AS {c}_p90, {at(0.99)} AS {c}_p99, CAST(max({c}) AS DOUBLE) AS {c}_max, round(avg({c}), 2) AS {c}_mean"


@query("index_percentiles", rf"""WITH p AS (SELECT lang AS language, length(text) AS chars, len(list_filter(regexp_split_to_array({_strip('text')}, '{_S}+'), lambda w: w <> '')) AS words,
  greatest(len(list_filter(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?।؟۔])[\s\x0b\x01]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')} <> '')), CASE WHEN {_strip('text')} <> '' THEN 1 ELSE 0 END) AS sentences,
  greatest(len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda s: {_strip('s')} <> '')), CASE WHEN {_strip('text')} <> '' THEN 1 ELSE 0 END) AS paragraphs FROM documents)
SELECT language, count(*) AS n, {', '.join(_index_sql(c) for c in ('chars', 'words', 'sentences', 'paragraphs'))}, round(100.0 * count(*) FILTER (sentences > 1) / count(*), 2) AS multi_sentence_pct, round(100.0 * count(*) FILTER (paragraphs > 1) / count(*), 2) AS multi_paragraph_pct FROM p GROUP BY 1""")
def index_percentiles(spark, sf_dir):
    return evaluation.length_profile(documents(spark, sf_dir), "language")


_EVAL = f"""{_PASSAGES}, ex AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN 'hi' ELSE 'ta' END AS shard_lang, CASE WHEN conv_id % 3 = 0 THEN 'DESCRIPTION' ELSE '' END AS labelled,
  coalesce(CASE WHEN conv_id % 5 = 0 THEN '' ELSE {_squeeze('nfc_normalize(tr[1])')} END, '') AS native,
  coalesce({_squeeze("regexp_replace(" + _squeeze("nfc_normalize('. ' || en[1])") + ", '^[" + _S[1:-1] + ".,;:!?—–*#>)(-]+', '')")}, '') AS eng FROM lists WHERE conv_id % 11 <> 0),
gold_of AS (SELECT query_id, string_agg(query_id || ':' || passage_index || ':' || language, ',' ORDER BY passage_index, passage_source) AS gold_document_ids FROM passages WHERE selected GROUP BY 1),
asked AS (SELECT query_id, shard_lang AS query_language, labelled, gold_document_ids, 'indic' AS query_source, native AS text FROM ex JOIN gold_of USING (query_id) WHERE native <> '' OR eng <> ''
  UNION ALL SELECT query_id, 'en', labelled, gold_document_ids, 'english', eng FROM ex JOIN gold_of USING (query_id) WHERE eng <> native),
ask AS (SELECT *, query_id AS conv_id, row_number() OVER () AS turn FROM asked WHERE text <> '')"""
_EVAL_FEATURES = _FEATURES.replace("conv_id, turn", "conv_id, turn, query_source, query_language, labelled, gold_document_ids").replace("FROM conversations", "FROM ask")


def _eval_examples(spark, sf_dir) -> DataFrame:
    return ingest.examples(raw_examples(spark, sf_dir))


@query("eval_build", f"""WITH {_EVAL}, {_EVAL_FEATURES} SELECT conv_id AS query_id, q AS query, query_language, gold_document_ids, labelled AS query_type, route AS expected_route,
  CASE route WHEN 'DEEP' THEN 'complex' WHEN 'ACCURATE' THEN 'moderate' ELSE 'simple' END AS complexity, query_source, n_tokens, n_chars FROM feat""")
def eval_build(spark, sf_dir):
    rows = evaluation.gold_set(_eval_examples(spark, sf_dir))
    return rows.withColumn("gold_document_ids", F.array_join("gold_document_ids", ","))


@query("eval_report", f"""WITH {_EVAL}, {_EVAL_FEATURES} SELECT (SELECT count(*) FROM ex WHERE native <> '' OR eng <> '') AS examples_seen,
  (SELECT count(*) FROM ex WHERE (native <> '' OR eng <> '') AND query_id NOT IN (SELECT query_id FROM gold_of)) AS examples_without_gold, CAST(0 AS BIGINT) AS dropped_no_indexed_gold,
  count(*) FILTER (query_source = 'indic') AS indic_emitted, count(*) FILTER (query_source = 'english') AS english_emitted,
  count(*) FILTER (route = 'FAST') AS fast_emitted, count(*) FILTER (route = 'ACCURATE') AS accurate_emitted, count(*) FILTER (route = 'DEEP') AS deep_emitted FROM feat""")
def eval_report(spark, sf_dir):
    """What building the evaluation set saw and left out."""
    return evaluation.gold_report(_eval_examples(spark, sf_dir))


@query("stratified_cap", f"WITH {_FEATURES}, t AS (SELECT conv_id, turn, role, route, row_number() OVER (PARTITION BY role, route ORDER BY conv_id, turn) AS rn FROM feat JOIN conversations USING (conv_id, turn)) SELECT conv_id, turn, role AS query_language, route AS expected_route FROM t ORDER BY rn, role, route LIMIT 20")
def stratified_cap(spark, sf_dir):
    rows = _features(spark, sf_dir).select("conv_id", F.col("turn").alias("t"), F.col("role").alias("query_language"), F.col("route").alias("expected_route"))
    return evaluation.stratified(rows, 20, ["conv_id", "t"]).select("conv_id", F.col("t").alias("turn"), "query_language", "expected_route")


@query("field_profile", " UNION ALL ".join(f"SELECT '{c}' AS field, '{t}' AS type, count(*) FILTER ({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') AS present, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS greatest FROM conversations" for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
def field_profile(spark, sf_dir):
    return evaluation.field_profile(table(spark, sf_dir, "conversations"))


@query("repeated_passages", f"SELECT count(*) AS unique_texts, CAST(sum(c - 1) AS BIGINT) AS repeats FROM (SELECT count(*) AS c FROM documents GROUP BY {_strip('text')})")
def repeated_passages(spark, sf_dir):
    return evaluation.repeated_texts(documents(spark, sf_dir))


@query("selected_per_example", """WITH c AS (SELECT conv_id, count(*) FILTER (turn % 3 = 1) AS k FROM conversations GROUP BY 1)
SELECT min(k) AS least, max(k) AS most, round(avg(k), 2) AS mean, (SELECT k FROM c GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS mode, count(*) FILTER (k >= 1) AS some, count(*) FILTER (k = 0) AS none, count(*) FILTER (k > 1) AS several FROM c""")
def selected_per_example(spark, sf_dir):
    k = _lists(spark, sf_dir).select(F.size(F.filter("sel", lambda s: s == "1")).cast("long").alias("k"))
    return k.agg(F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 2).alias("mean"), F.mode("k", deterministic=True).alias("mode"), F.count_if(F.col("k") >= 1).alias("some"), F.count_if(F.col("k") == 0).alias("none"), F.count_if(F.col("k") > 1).alias("several"))


@query("passage_stats", f"""WITH {_SENT} SELECT count(*) AS passages, count(*) FILTER (is_selected) AS selected_passages, round(avg(c), 2) AS avg_chars, round(avg(len(s)), 2) AS avg_sentences,
  count(*) FILTER (len(s) <= 1) AS single_sentence, count(*) FILTER (len(s) > 1) AS multi_sentence FROM sent JOIN (SELECT doc_id, length(text) AS c FROM documents) USING (doc_id)""")
def passage_stats(spark, sf_dir):
    return evaluation.passage_stats(_passages(spark, sf_dir))


@query("inspect_raw", f"""WITH {_LISTS}, r AS (SELECT *, len(list_filter(sel, lambda x: x)) AS k, coalesce({_squeeze('tr[1]')}, '') = '' AS bare FROM lists)
SELECT count(*) AS examples, count(*) FILTER (conv_id % 11 <> 0) AS usable_ids, CAST(0 AS BIGINT) AS repeated_ids, count(*) FILTER (conv_id % 5 = 0 OR bare) AS blank_query, count(*) FILTER (en[1] IS NULL) AS blank_eng_query,
  count(*) FILTER (bare) AS blank_answer, count(*) AS blank_eng_answer, count(*) FILTER (conv_id % 3 <> 0) AS blank_query_type, count(*) FILTER (en[1] IS NOT NULL) AS stray_punctuation,
  CAST(sum(len(en)) AS BIGINT) AS english_passages, CAST(sum(len(tr)) AS BIGINT) AS translated_passages, count(*) FILTER (len(en) <> len(tr) OR len(en) <> len(sel)) AS different_lengths,
  CAST(min(k) AS INT) AS selected_least, CAST(max(k) AS INT) AS selected_most, round(avg(k), 2) AS selected_mean, CAST((SELECT k FROM r GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS INT) AS selected_mode,
  count(*) FILTER (k = 0) AS none_selected, count(*) FILTER (k > 1) AS several_selected FROM r""")
def inspect_raw(spark, sf_dir):
    return evaluation.inspected(raw_examples(spark, sf_dir))


@query("query_id_profile", "SELECT count(*) AS n, count(DISTINCT user_id) AS distinct_ids, count(*) - count(DISTINCT user_id) AS repeated_ids, min(user_id) AS least, max(user_id) AS greatest FROM events")
def query_id_profile(spark, sf_dir):
    i = F.col("user_id")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.countDistinct(i).alias("distinct_ids"), (F.count("*") - F.countDistinct(i)).alias("repeated_ids"), F.min(i).alias("least"), F.max(i).alias("greatest"))


_RERANKED = f"""r AS (SELECT h.query_id, h.doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY round(len(list_intersect(list_distinct({_tokens('b.text')}), list_distinct({_tokens('d.text')}))) / len(list_distinct({_tokens('b.text')})), 6) DESC, h.rank) AS rank
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id))"""


@query("policy_comparison", f"""WITH {_HYBRID}, {_SIGNALS}, {_BENCH_FEATURES}, {_GOLD}, {_RERANKED}, {_DECIDED},
f AS (SELECT v.strategy, d.query_id, CASE v.strategy WHEN 'always' THEN true WHEN 'never' THEN false ELSE d.skip IS NULL END AS applied FROM d, (VALUES ('always'), ('never'), ('adaptive')) v(strategy)),
a AS (SELECT f.strategy, f.query_id, r.doc_id, r.rank FROM f JOIN r ON r.query_id = f.query_id WHERE applied UNION ALL SELECT f.strategy, f.query_id, h.doc_id, h.rank FROM f JOIN hits h ON h.query_id = f.query_id WHERE NOT applied),
m AS (SELECT strategy, query_id, min(rank) AS best FROM a JOIN gold USING (query_id, doc_id) GROUP BY ALL),
q AS (SELECT f.strategy, f.applied, f.query_id IN (SELECT query_id FROM gold) AS has, best FROM f LEFT JOIN m USING (strategy, query_id))
SELECT strategy, count(*) FILTER (has) AS n, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END) FILTER (has), 4) AS recall_at_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END) FILTER (has), 4) AS recall_at_5,
  round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END) FILTER (has), 4) AS recall_at_10, round(avg(coalesce(1.0 / best, 0)) FILTER (has), 4) AS mrr, round(100.0 * count(*) FILTER (applied) / count(*), 1) AS pct_reranked FROM q GROUP BY 1""")
def policy_comparison(spark, sf_dir):
    """Recall and share of reranked questions when reranking always, never and by the policy."""
    stable_unions(spark)
    q = questions(spark, sf_dir)
    hits = settled(ranking.beside(_hits(spark, sf_dir), q.withColumnRenamed("text", "query"), "query_id", text="query"))  # ten a question
    flags = ranking.decisions(routing.features(q).join(ranking.signals(hits), "query_id", "left")).select("query_id", "applied")
    policies = F.array(*(F.struct(F.lit(n).alias("strategy"), f.alias("applied")) for n, f in (("always", F.lit(True)), ("never", F.lit(False)), ("adaptive", F.col("applied")))))
    flags = flags.select(F.col("query_id").alias("id"), F.inline(policies))
    # A policy's questions are questions of their own.
    named = F.concat_ws(":", "strategy", F.col("id").cast("string"))
    asked = flags.withColumn("query_id", named)
    marked = hits.withColumnRenamed("query_id", "id").join(asked, "id")
    rest = marked.where("not applied").select("query_id", "doc_id", "rank")
    ranked = ranking.rerank_lexical(marked.where("applied"), 12).select("query_id", "doc_id", "rank").unionByName(rest)
    gold = _gold(spark, sf_dir).withColumnRenamed("query_id", "id").join(asked.select("id", "query_id"), "id")
    per = evaluation.per_query(ranked, gold, asked.select("query_id", "strategy", "applied"))
    return per.groupBy("strategy").agg(*evaluation.metric_block(), M.share(F.col("applied"), 1).alias("pct_reranked"))


@query("system_comparison", f"""WITH {_HYBRID}, {_GOLD},
r AS (SELECT h.query_id, h.doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY round(len(list_intersect(list_distinct({_tokens('b.text')}), list_distinct({_tokens('d.text')}))) / len(list_distinct({_tokens('b.text')})), 6) DESC, h.rank) AS rank
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id)),
a AS (SELECT 'dense' AS retriever, query_id, doc_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hits UNION ALL SELECT 'hybrid+rerank', query_id, doc_id, rank FROM r),
m AS (SELECT retriever, query_id, rank FROM a JOIN gold USING (query_id, doc_id)),
q AS (SELECT retriever, g.query_id, min(rank) AS best FROM (VALUES ('dense'), ('bm25'), ('hybrid'), ('hybrid+rerank')) v(retriever) CROSS JOIN (SELECT DISTINCT query_id FROM gold) g LEFT JOIN m USING (retriever, query_id) GROUP BY ALL)
SELECT retriever, count(*) AS n, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(coalesce(1.0 / best, 0)), 4) AS mrr FROM q GROUP BY 1""")
def system_comparison(spark, sf_dir):
    """Recall and reciprocal rank of dense, lexical, fused and always reranked search."""
    stable_unions(spark)
    q = questions(spark, sf_dir)
    lists = [(name, settled(df)) for name, df in hybrid_lists(spark, sf_dir, q, 20)]
    fused = settled(ranking.fuse(lists))
    hits = ranking.beside(ranking.beside(documents(spark, sf_dir).select("doc_id", "text"), fused, "doc_id"), q.withColumnRenamed("text", "query"), "query_id", text="query")
    systems = [*((name, df.where("rank <= 10")) for name, df in lists), ("hybrid", fused), ("hybrid+rerank", ranking.rerank_lexical(hits, 12))]
    named = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    ranked = gold = asked = None
    found = settled(_gold(spark, sf_dir))
    for name, df in systems:
        parts = (df.select(named(name, "query_id").alias("query_id"), "doc_id", "rank"), found.select(named(name, "query_id").alias("query_id"), "doc_id"), q.select(named(name, "query_id").alias("query_id"), F.lit(name).alias("retriever")))
        ranked, gold, asked = parts if ranked is None else (a.unionByName(b) for a, b in zip((ranked, gold, asked), parts, strict=True))
    return evaluation.per_query(ranked, gold, asked).groupBy("retriever").agg(*evaluation.metric_block())


@query("gold_by_language", f"WITH {_PASSAGES} SELECT query_id, count(*) FILTER (language = 'en') AS english, count(*) FILTER (language <> 'en') AS native FROM passages WHERE selected GROUP BY 1")
def gold_by_language(spark, sf_dir):
    """Gold ids of each example by the language that ends them."""
    e = _eval_examples(spark, sf_dir).where(F.size("gold_document_ids") > 0)
    count = lambda keep: F.size(F.filter("gold_document_ids", keep)).cast("long")
    return e.select("query_id", count(lambda g: g.endswith(":en")).alias("english"), count(lambda g: ~g.endswith(":en")).alias("native"))


@query("flat_fields", "SELECT DISTINCT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def flat_fields(spark, sf_dir):
    """The keys that JSON values have, and how often."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_JSON_KINDS = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END"


@query("nested_profile", f"""WITH t AS (SELECT props, json_valid(props) AS good FROM clicks),
v AS (SELECT regexp_replace(j.fullkey, '\\[\\d+\\]', '[]', 'g') AS path, {_JSON_KINDS} AS kind, j.value, CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j.value ->> '$' END AS t
  FROM (SELECT props FROM t WHERE good) g, json_tree(g.props) j),
s AS (SELECT path, kind, t, CASE kind WHEN 'object' THEN len(json_keys(value)) WHEN 'array' THEN json_array_length(value) WHEN 'string' THEN length(t) END AS size FROM v
  UNION ALL SELECT '$', CASE WHEN props IS NULL THEN 'missing' ELSE 'malformed' END, NULL, NULL FROM t WHERE good IS NOT TRUE)
SELECT path, kind, count(*) AS n, count(*) FILTER (kind IN ('null', 'missing') OR size = 0 OR (kind = 'string' AND trim(t) = '')) AS n_empty, CAST(min(size) AS BIGINT) AS least_size, CAST(max(size) AS BIGINT) AS most_size,
  CAST(sum(size) AS BIGINT) AS total_size, min(substr(t, 1, 80)) AS least, max(substr(t, 1, 80)) AS greatest FROM s GROUP BY path, kind""")
def nested_profile(spark, sf_dir):
    """Paths, kinds, sizes and previews of the values in JSON texts whose schema nobody stated."""
    return profiling.nested_profile(table(spark, sf_dir, "clicks"), "props")


# Tables and sets ------------------------------------------------------------------------------


@query("upsert_merge", "SELECT doc_id, lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -1 - doc_id, lang, 'new' FROM documents WHERE doc_id % 16 = 0")
def upsert_merge(spark, sf_dir):
    have = documents(spark, sf_dir).drop("text")
    changed = have.where("doc_id % 4 = 0").withColumn("source", F.lit("new"))
    more = changed.where("doc_id % 16 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    new = changed.unionByName(more).withColumn("seq", F.lit(1))
    return catalog.upsert(have, changed.withColumns({"source": F.lit("old"), "seq": F.lit(0)}).unionByName(new), "doc_id", F.col("seq")).drop("seq")


@query("set_ops_langs", "SELECT source, lang AS language, 'only_labelled' AS kind FROM (SELECT source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) EXCEPT SELECT source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT source, lang, 'both' FROM (SELECT source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT SELECT source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def set_ops_langs(spark, sf_dir):
    d, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    a, b = (d.join(labels, "doc_id", how).select("source", "language").distinct() for how in ("left_semi", "left_anti"))
    return a.subtract(b).withColumn("kind", F.lit("only_labelled")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


@query("semi_anti_gold", f"WITH {_GOLD} SELECT (SELECT count(DISTINCT query_id) FROM gold) AS with_gold, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)) AS without_gold, (SELECT count(*) FROM gold WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled_gold")
def semi_anti_gold(spark, sf_dir):
    g, q = settled(_gold(spark, sf_dir)), questions(spark, sf_dir)
    parts = [
        q.join(g, "query_id", "left_semi").agg(F.count("*").alias("with_gold")), q.join(g, "query_id", "left_anti").agg(F.count("*").alias("without_gold")),
        g.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").agg(F.count("*").alias("labelled_gold")),
    ]
    return parts[0].join(F.broadcast(parts[1]), F.lit(True)).join(F.broadcast(parts[2]), F.lit(True))


@query("keep_first_batches", f"""WITH k AS (SELECT doc_id, doc_id % 3 AS batch, {_KEY} AS key, row_number() OVER (PARTITION BY lang, {_KEY} ORDER BY doc_id % 3, doc_id) AS n, count(*) OVER (PARTITION BY lang, {_KEY}, doc_id % 3) AS c FROM documents)
SELECT doc_id, CAST(batch AS INT) AS batch, c - 1 AS repeats FROM k WHERE n = 1""")
def keep_first_batches(spark, sf_dir):
    """Documents come in three batches; each keeps those whose text no earlier one had, by a table of keys."""
    seen = SeenKeys(spark, f"{shared_dir(spark)}/ragweave/seen/{uuid.uuid4().hex}")
    stable_unions(spark)
    out = None
    for batch in range(3):
        d = documents(spark, sf_dir).where(F.pmod("doc_id", F.lit(3)) == batch)
        kept = seen.first(d, [F.col("language"), X.dedupe_key(F.col("text"))], ["doc_id"], batch)
        kept = kept.select("doc_id", F.lit(batch).alias("batch"), "repeats")
        out = kept if out is None else out.unionByName(kept)
    return out


@query("shard_catalog", "SELECT source || '/' || split AS path, split, stem, lang FROM (SELECT DISTINCT source, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, CASE WHEN lang = 'en' THEN 'hin' ELSE 'tam' END AS stem, CASE WHEN lang = 'en' THEN 'hi' ELSE 'ta' END AS lang FROM documents)")
def shard_catalog(spark, sf_dir):
    """Shard files named after documents; files of unknown stems go."""
    d = documents(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    split, end = F.when(even, "train").otherwise("validation"), F.when(even, "train").otherwise("val")
    stem = F.when(F.col("language") == "en", "hin").otherwise("tam")
    path = lambda s: F.concat(F.col("source"), F.lit("/"), split, F.lit("/"), s, end, F.lit(".parquet"))
    found = catalog.shards(d.select(path(stem).alias("path")).union(d.select(path(F.lit("xyz")))).distinct())
    return found.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))


@query("cache_lookup", "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS hit FROM documents")
def cache_lookup(spark, sf_dir):
    wanted = documents(spark, sf_dir).select(F.col("doc_id").alias("cache_key"))
    cache = vectors(spark, sf_dir).select(F.col("doc_id").alias("cache_key"), "embedding")
    hit = catalog.cache_hits(wanted, cache, 64).select(F.col("cache_key").alias("doc_id"), F.lit(True).alias("hit"))
    return hit.unionByName(catalog.cache_misses(wanted, cache, 64).select(F.col("cache_key").alias("doc_id"), F.lit(False).alias("hit")))


@query("vector_statistics", "SELECT count(*) AS n, CAST(max(len(embedding)) AS INT) AS dimension FROM embeddings")
def vector_statistics(spark, sf_dir):
    return catalog.statistics(catalog.checked_dimension(vectors(spark, sf_dir), 64))
