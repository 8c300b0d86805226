"""Evaluation: gold sets, retrieval metrics with breakdowns, chunk metrics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.functions import measures as M
from ragweave.functions import text as X
from ragweave.functions.session import settled
from ragweave.operators import routing
from ragweave.operators.ranking import beside


def per_query(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, r1, r5, r10 and mrr; null for queries without gold.

    ``ranked`` has query_id, doc_id, rank (documents may repeat), ``gold`` query_id, doc_id.
    """
    marked = ranked.join(gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(True)), ["query_id", "doc_id"], "left")
    is_gold = F.coalesce("g", F.lit(False))
    found = marked.groupBy("query_id").agg(*(M.recall_at(F.col("rank"), is_gold, k).alias(f"r{k}") for k in (1, 5, 10)), M.reciprocal_rank(F.col("rank"), is_gold).alias("mrr"))
    has = gold.select("query_id").distinct().withColumn("has", F.lit(True))
    out = queries.join(has, "query_id", "left").join(found, "query_id", "left")
    value = lambda c: F.when(F.col("has"), F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return out.select(*queries.columns, *(value(c) for c in ("r1", "r5", "r10", "mrr")))


def holding(docs: DataFrame, queries: DataFrame, width: int = 3) -> DataFrame:
    """query_id and doc_id of the documents (doc_id, text) whose text contains the query's (query_id, text).

    A text that holds another has its tokens in a row, but for the first and the last, which may be
    parts of longer ones. Runs of up to ``width`` of them are hashed and joined, a row a place in a text, and the
    pairs that meet are compared, each once. Queries of fewer than three tokens have no such run; they are compared with all texts.
    """
    # At the end of a text runs are shorter: they may meet a shorter query's, and are compared.
    run = lambda t, i, n: F.xxhash64(*(F.get(F.col(t), i + j) for j in range(n)))
    asked = queries.select(F.col("query_id").alias("query_id"), F.col("text").alias("qt"), X.tokens(F.col("text")).alias("q"))
    inner = asked.where(F.size("q") > 2).select("query_id", F.slice("q", F.lit(2), F.least(F.size("q") - 2, F.lit(width))).alias("run"))
    widths = [r["n"] for r in inner.select(F.size("run").alias("n")).distinct().collect()]  # ``width`` at most
    keyed = inner.select("query_id", run("run", F.lit(0), width).alias("h")).distinct()
    found = docs.select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "doc_id", "text", F.lit("").alias("qt")).where("false")
    if widths:
        rows = docs.select("doc_id", F.inline(F.array(F.struct(X.tokens(F.col("text")).alias("t")))))
        places = rows.select("doc_id", "t", F.posexplode("t").alias("i", "w"))
        hashes = [run("t", F.col("i"), n).alias("h") for n in widths]
        places = places.select("doc_id", hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes)).alias("h"))
        pairs = settled(beside(places, keyed, "h").select(F.col("query_id").alias("__q"), F.col("doc_id").alias("__d")).distinct())
        texts = beside(docs.select("doc_id", "text"), pairs, F.col("doc_id").eqNullSafe(F.col("__d")))
        met = beside(texts, asked.where(F.size("q") > 2).select("query_id", "qt"), F.col("query_id").eqNullSafe(F.col("__q")), text="qt")
        found = met.select("query_id", "doc_id", "text", "qt")
    short = asked.where((F.size("q") <= 2) & F.col("qt").isNotNull())
    if not short.isEmpty():
        found = found.unionByName(beside(docs, short, F.expr("contains(text, qt)"), text="qt").select("query_id", "doc_id", "text", "qt"))
    return found.where("contains(text, qt)").select("query_id", "doc_id")


def metric_block() -> list[Column]:
    return [F.count("r10").alias("n"), *(M.mean_finite(F.col(c)).alias(a) for c, a in (("r1", "recall_at_1"), ("r5", "recall_at_5"), ("r10", "recall_at_10"), ("mrr", "mrr")))]


def breakdowns(rows: DataFrame, keys: list[str], timed: str | None = None, prefix: str = "lat_") -> DataFrame:
    """Metrics over all rows and by each key alone, in one pass; blank keys are ``unknown``.

    Returns dimension (``all`` or the key's name), value and the metrics; with ``timed``, a column of
    latencies, their mean and percentiles too.
    """
    named = rows.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("unknown")) for k in keys})
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in keys))
    out = named.select("*", F.inline(pairs))
    found = out.groupBy("dimension", "value").agg(*metric_block())
    if timed is None:
        return found
    return M.beside_groups(found, M.latency(out.withColumnRenamed(timed, "__timed"), ["dimension", "value"], "__timed", prefix), ["dimension", "value"])


def still_indexed(examples: DataFrame, indexed: DataFrame) -> DataFrame:
    """Examples with only those of their gold ids that are ``indexed`` (doc_id), in order; each row by itself, ids may repeat."""
    others = [c for c in examples.columns if c != "gold_document_ids"]
    rows = examples.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.struct(*others).alias("__head"), F.explode_outer("gold_document_ids").alias("doc_id"))
    rows = rows.join(indexed.select("doc_id", F.lit(True).alias("__in")).distinct(), "doc_id", "left")
    found = F.array_sort(F.collect_set(F.when(F.col("__in"), F.col("doc_id"))))
    out = rows.groupBy("__row").agg(F.first("__head").alias("__head"), found.alias("gold_document_ids"))
    return out.select(*(F.col(f"__head.{c}") if c != "gold_document_ids" else F.col(c) for c in examples.columns))


def gold_set(examples: DataFrame, indexed: DataFrame | None = None, include_english: bool = True) -> DataFrame:
    """Evaluation rows of examples: the native query and, if it differs, the English one, with gold and features.

    Gold ids that are not ``indexed`` (doc_id) go, and examples without any left.
    """
    df = examples if indexed is None else still_indexed(examples, indexed).where(F.size("gold_document_ids") > 0)
    native, eng = X.squeeze_ends(F.coalesce("query", F.lit(""))), X.squeeze_ends(F.coalesce("eng_query", F.lit("")))
    own = F.struct(native.alias("text"), F.coalesce("shard_lang", X.script_language(native)).alias("query_language"), F.lit("indic").alias("query_source"))
    english = F.struct(eng.alias("text"), F.lit("en").alias("query_language"), F.lit("english").alias("query_source"))
    both = F.array(own, *([F.when(eng != native, english)] if include_english else []))
    rows = df.where(F.size("gold_document_ids") > 0).select("query_id", "query_type", "gold_document_ids", F.explode(both).alias("r"))
    rows = rows.where("r.text is not null and r.text != ''").select("query_id", F.col("query_type").alias("labelled_type"), "gold_document_ids", "r.*")
    return routing.features(rows).select("query_id", F.col("text").alias("query"), "query_language", "gold_document_ids", F.col("labelled_type").alias("query_type"), F.col("route").alias("expected_route"), "complexity", "query_source", "n_tokens", "n_chars")


def gold_report(examples: DataFrame, indexed: DataFrame | None = None, include_english: bool = True) -> DataFrame:
    """One row of what ``gold_set`` saw and left out: examples, those without gold or without any left, and rows by source and route."""
    rows = gold_set(examples, indexed, include_english).agg(
        F.count_if(F.col("query_source") == "indic").alias("indic_emitted"), F.count_if(F.col("query_source") == "english").alias("english_emitted"),
        *(F.count_if(F.col("expected_route") == r).alias(f"{r.lower()}_emitted") for r in ("FAST", "ACCURATE", "DEEP")),
    )
    some = F.size("gold_document_ids") > 0
    df = examples.select("gold_document_ids", some.alias("some"))
    df = df if indexed is None else still_indexed(df, indexed)
    left = F.size("gold_document_ids") > 0
    seen = df.agg(F.count("*").alias("examples_seen"), F.count_if(~F.col("some")).alias("examples_without_gold"), F.count_if(F.col("some") & ~left).alias("dropped_no_indexed_gold"))
    return seen.join(F.broadcast(rows), F.lit(True))  # one row each


def reasons(chunks: DataFrame) -> DataFrame:
    """How many chunks each adaptive reason made."""
    return chunks.where("adaptive_reason is not null").groupBy("adaptive_reason").agg(F.count("*").alias("chunks"))


def stratified(rows: DataFrame, cap: int, order: list) -> DataFrame:
    """``cap`` rows taken in turn from the (language, route) groups, the groups sorted."""
    turn = Window.partitionBy("query_language", "expected_route").orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(turn)).orderBy("turn", "query_language", "expected_route").limit(cap)


def chunk_metrics(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per strategy: counts, lengths, chunks per passage and coverage of gold passages."""
    # Texts are cut once: what follows reads the chunks' sizes many times.
    chunks = settled(chunks.select("chunk_strategy", "document_id", "char_length", "sentence_count"))
    per_doc = settled(chunks.groupBy("chunk_strategy", "document_id").agg(F.count("*").alias("k")))
    spread = per_doc.groupBy("chunk_strategy").agg(F.round(F.avg("k"), 3).alias("chunks_per_passage"), F.count("*").alias("chunked_passages"))
    sizes = chunks.groupBy("chunk_strategy").agg(
        F.count("*").alias("chunks"), F.round(F.avg("char_length"), 2).alias("avg_chars"),
        F.min("char_length").alias("min_chars"), F.max("char_length").alias("max_chars"), F.round(F.avg("sentence_count"), 3).alias("avg_sentences"),
        F.min("sentence_count").alias("min_sentences"), F.max("sentence_count").alias("max_sentences"),
    )
    ranks = M.percentiles(chunks, ["chunk_strategy"], {"p90_chars": ("char_length", M.nearest(90)), "median_chars": ("char_length", 50), "median_sentences": ("sentence_count", 50)})
    middle = M.percentiles(per_doc, ["chunk_strategy"], {"median_chunks": ("k", 50)})
    ranks = ranks.join(middle, "chunk_strategy").withColumns({"p90_chars": F.col("p90_chars").cast("int")} | {c: F.round(c, 3) for c in ("median_chars", "median_sentences", "median_chunks")})
    total = passages.agg(F.count("*").alias("passages"), F.count_if("is_selected").alias("gold"))
    covered = passages.where("is_selected").select("document_id").distinct().join(per_doc.select("chunk_strategy", "document_id"), "document_id").groupBy("chunk_strategy").agg(F.count("*").alias("covered"))
    out = sizes.join(spread, "chunk_strategy").join(ranks, "chunk_strategy").join(covered, "chunk_strategy", "left").join(F.broadcast(total), F.lit(True))
    out = out.withColumns({"zero_chunk_passages": F.col("passages") - F.col("chunked_passages"), "gold_coverage_pct": F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.nullif("gold", F.lit(0)), 2)})
    return out.drop("covered", "chunked_passages", "passages", "gold")


def overlap_ratio(chunks: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the sentence ranges of neighbouring chunks, by strategy."""
    order = Window.partitionBy("chunk_strategy", "document_id").orderBy("chunk_index")
    pairs = chunks.select("chunk_strategy", F.col("start_sentence").alias("a1"), F.col("end_sentence").alias("b1"), F.lead("start_sentence").over(order).alias("a2"), F.lead("end_sentence").over(order).alias("b2")).where("a2 is not null")
    both = F.greatest(F.lit(0), F.least("b1", "b2") - F.greatest("a1", "a2") + 1)
    either = (F.col("b1") - F.col("a1") + 1) + (F.col("b2") - F.col("a2") + 1) - both
    return pairs.groupBy("chunk_strategy").agg(F.count("*").alias("pairs"), F.round(F.avg(both / either), 4).alias("overlap_ratio"))


def length_profile(df: DataFrame, by: str) -> DataFrame:
    """Characters, words, sentences and paragraphs of texts by group, with index percentiles."""
    text = F.coalesce("text", F.lit(""))
    some = (X.squeeze_ends(text) != "").cast("int")
    # Texts are measured once: each pass for percentiles reads the counts.
    df = settled(df.select(
        by, F.length(text).alias("chars"), F.size(F.filter(F.split(X.squeeze_ends(text), X.SPACE), lambda w: w != "")).alias("words"),
        F.greatest(F.size(X.profile_sentences(text)), some).alias("sentences"), F.greatest(F.size(X.paragraphs(text)), some).alias("paragraphs"),
    ))
    out = [F.count("*").alias("n")]
    for c in ("chars", "words", "sentences", "paragraphs"):
        out += [F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"), F.round(F.avg(c), 2).alias(f"{c}_mean")]
    sums = df.groupBy(by).agg(*out, M.share(F.col("sentences") > 1).alias("multi_sentence_pct"), M.share(F.col("paragraphs") > 1).alias("multi_paragraph_pct"))
    wanted = {f"{c}_p{p}": (c, M.cut(s)) for c in ("chars", "words", "sentences", "paragraphs") for s, p in ((0.5, 50), (0.9, 90), (0.99, 99))}
    ranks = M.at_indexes(df, [by], wanted).withColumnRenamed(by, "__by")
    return sums.join(ranks, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def field_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, present, missing (null or blank) and two sample values, the least and the greatest."""
    kinds = dict(df.dtypes)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("v")) for c in df.columns))
    rows = df.select(F.inline(pairs))
    blank = F.col("v").isNull() | (F.btrim("v") == "")
    return rows.groupBy("field", "type").agg(F.count_if(~blank).alias("present"), F.count_if(blank).alias("missing"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def passage_stats(passages: DataFrame) -> DataFrame:
    """One row: passages, selected ones, mean characters and sentences, and how many have at most one sentence or more."""
    n = F.size(X.sentences(F.col("text")))
    df = passages.select(F.length(F.coalesce("text", F.lit(""))).alias("chars"), n.alias("n"), F.coalesce("is_selected", F.lit(False)).alias("selected"))
    return df.agg(
        F.count("*").alias("passages"), F.count_if("selected").alias("selected_passages"), F.round(F.avg("chars"), 2).alias("avg_chars"), F.round(F.avg("n"), 2).alias("avg_sentences"),
        F.count_if(F.col("n") <= 1).alias("single_sentence"), F.count_if(F.col("n") > 1).alias("multi_sentence"),
    )


#: Fixed value: what an English query may be left with at its start.
STRAY = ".?!,:;"


def inspected(raw: DataFrame) -> DataFrame:
    """One row about raw examples: ids, blank fields, stray punctuation, passages and selected ones, lists of different lengths."""
    blank = lambda c: F.coalesce(X.squeeze_ends(F.col(c).cast("string")), F.lit("")) == ""
    lists = [F.col(f"passages.{c}") for c in ("English_passages", "Translated_passages", "is_selected")]
    sizes = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)) for x in lists]
    selected = F.size(F.filter(F.coalesce(lists[2], F.array().cast("array<string>")), lambda s: F.coalesce(s.cast("string") == "1", F.lit(False))))
    df = raw.select("*", F.expr("try_cast(query_id as bigint)").alias("__id"), selected.alias("__k"))
    stray = F.substring(F.coalesce("Eng_Query", F.lit("")), 1, 1)
    return df.agg(
        F.count("*").alias("examples"), F.count("__id").alias("usable_ids"), (F.count("__id") - F.count_distinct("__id")).alias("repeated_ids"),
        *(F.count_if(blank(c)).alias(f"blank_{c.lower()}") for c in ("query", "Eng_Query", "Answer", "Eng_Answer", "query_type")),
        F.count_if((stray != "") & (F.instr(F.lit(STRAY), stray) > 0)).alias("stray_punctuation"), F.sum(sizes[0]).alias("english_passages"), F.sum(sizes[1]).alias("translated_passages"),
        F.count_if((sizes[0] != sizes[1]) | (sizes[0] != sizes[2])).alias("different_lengths"), F.min("__k").alias("selected_least"), F.max("__k").alias("selected_most"),
        F.round(F.avg("__k"), 2).alias("selected_mean"), F.mode("__k", deterministic=True).alias("selected_mode"), F.count_if(F.col("__k") == 0).alias("none_selected"), F.count_if(F.col("__k") > 1).alias("several_selected"),
    )


def repeated_texts(df: DataFrame) -> DataFrame:
    """unique and repeats of trimmed texts."""
    by = df.groupBy(F.xxhash64(X.squeeze_ends(F.coalesce("text", F.lit("")))).alias("h")).agg(F.count("*").alias("c"))
    return by.agg(F.count("*").alias("unique_texts"), F.sum(F.col("c") - 1).alias("repeats"))
