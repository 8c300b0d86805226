"""Raw nested examples to clean examples, passages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ragweave.config import IngestConfig
from ragweave.functions import text as X

META = ("model_name", "temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty")


def aligned(english: Column, translated: Column, selected: Column) -> Column:
    """Three parallel arrays as one of structs (i, en, tr, selected).

    If none is empty the shortest rules, else the longest, padded with nulls and zeros.
    """
    sizes = [F.coalesce(F.greatest(F.size(a), F.lit(0)), F.lit(0)) for a in (english, translated, selected)]
    n = F.when(F.least(*sizes) > 0, F.least(*sizes)).otherwise(F.greatest(*sizes))
    row = lambda i: F.struct(i.alias("i"), F.get(english, i).alias("en"), F.get(translated, i).alias("tr"), F.coalesce(F.get(selected, i).cast("string").eqNullSafe("1"), F.lit(False)).alias("selected"))
    none = F.array().cast("array<struct<i:int,en:string,tr:string,selected:boolean>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(none)


def passage_array(pairs: Column, query_id: Column, shard: Column, source: Column, target: Column, cfg: IngestConfig) -> Column:
    """Passage structs of aligned rows: the English one, then the translated one, of each index; blank ones are left out."""

    def passage(p: Column, text: Column, language: Column, flores: Column, kind: str) -> Column:
        clean = X.cleaned(text)
        return F.struct(
            X.passage_id(query_id, p["i"], language).alias("document_id"), query_id.alias("query_id"), p["i"].alias("passage_index"), clean.alias("text"), language.alias("language"),
            flores.alias("language_flores"), p["selected"].alias("is_selected"), F.lit(kind).alias("passage_source"), F.length(clean).alias("char_length"),
        )

    def both(p: Column) -> Column:
        kinds = []
        if cfg.include_english:
            kinds.append(passage(p, p["en"], F.lit("en"), source, "english"))
        if cfg.include_translated:
            kinds.append(passage(p, p["tr"], shard, target, "translated"))
        return F.array(*kinds)

    return F.filter(F.flatten(F.transform(pairs, both)), lambda p: p["text"].isNotNull())


def examples(raw: DataFrame, cfg: IngestConfig | None = None, seen: Observation | None = None) -> DataFrame:
    """Clean examples of raw rows (shard_lang, split and the raw fields), with their passages and gold ids.

    Rows without a castable query_id go; those with both queries blank go if asked, and likewise
    those without any answer. ``seen`` observes what was read and left out, in the same pass.
    """
    cfg = cfg or IngestConfig()
    df = _flagged(raw, cfg)
    df = (df if seen is None else df.observe(seen, *seen_metrics())).where("__why is null").drop("__why")
    made = passage_array(F.col("__pairs"), F.col("query_id"), F.col("shard_lang"), F.col("source_lang"), F.col("target_lang"), cfg)
    df = df.withColumns({"passages": made, "raw_passage_count": F.size("__pairs"), "query": F.coalesce("query", F.lit("")), "eng_query": F.coalesce("eng_query", F.lit(""))}).drop("__pairs")
    return with_gold(df)


def _flagged(raw: DataFrame, cfg: IngestConfig) -> DataFrame:
    """Cleaned rows with ``__why``: what leaves a row out (unusable_id, empty_query, no_answer), null where nothing does."""
    df = raw.withColumn("query_id", F.expr("try_cast(query_id as bigint)"))
    # Composed before the arrays are zipped, each array in one call.
    df = df.withColumns({c: X.nfc(F.col(c).cast("string")) for c in ("query", "Eng_Query", "Answer", "Eng_Answer")} | {f"__{c}": X.nfc_each(F.col(f"passages.{c}")) for c in ("English_passages", "Translated_passages")})
    source, target = F.coalesce(F.nullif("source_lang", F.lit("")), F.lit("eng_Latn")), F.coalesce(F.nullif("target_lang", F.lit("")), F.col("shard_lang"))
    pairs = aligned(F.col("__English_passages"), F.col("__Translated_passages"), F.col("passages.is_selected"))
    df = df.select(
        "query_id", "shard_lang", "split", source.alias("source_lang"), target.alias("target_lang"), X.cleaned(F.col("query")).alias("query"), X.cleaned(F.col("Eng_Query"), leading=True).alias("eng_query"),
        X.cleaned(F.col("Answer")).alias("answer"), X.cleaned(F.col("Eng_Answer")).alias("eng_answer"), F.col("query_type").cast("string").alias("query_type"), "meta", pairs.alias("__pairs"),
    )
    none = F.lit(False)
    empty = F.col("query").isNull() & F.col("eng_query").isNull() if cfg.skip_empty_queries else none
    unanswered = F.col("answer").isNull() & F.col("eng_answer").isNull() if cfg.drop_empty_answers else none
    return df.withColumn("__why", F.when(F.col("query_id").isNull(), "unusable_id").when(empty, "empty_query").when(unanswered, "no_answer"))


def _long(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def seen_metrics() -> list[Column]:
    """Counts over the flagged rows: what was read and what leaves rows out."""
    why = F.col("__why")
    out = [F.count_if(why == reason).alias(name) for reason, name in (("unusable_id", "unusable_ids"), ("empty_query", "empty_queries"), ("no_answer", "without_any_answer"))]
    return [F.count("*").alias("records_processed"), F.count_if(why.isNotNull()).alias("records_skipped"), *out]


def given_metrics() -> list[Column]:
    """Counts over the examples that a run gives."""
    chars = F.aggregate("passages", F.lit(0).cast("long"), lambda a, p: a + p["char_length"])
    return [
        F.count("*").alias("records_emitted"), F.count_if(F.col("answer").isNull()).alias("empty_answers"), F.count_if(F.col("eng_answer").isNull()).alias("empty_eng_answers"),
        F.count_if(F.size("passages") == 0).alias("without_passages"), _long(F.size("passages")).alias("passages_emitted"),
        _long(F.length("query") + F.length("eng_query")).alias("query_chars"), _long(chars).alias("passage_chars"),
    ]


def report(raw: DataFrame, cfg: IngestConfig | None = None) -> DataFrame:
    """One row of what an ingest run saw, left out and gave. A run itself observes these while it writes."""
    cfg = cfg or IngestConfig()
    seen = _flagged(raw, cfg).select("__why").agg(*seen_metrics())
    full = examples(raw, cfg)
    given = (deduped(full, cfg.dedupe_scope) if cfg.dedupe else full).agg(*given_metrics())
    before = full.agg(_long(F.size("passages")).alias("__all"))
    out = seen.join(F.broadcast(given), F.lit(True)).join(F.broadcast(before), F.lit(True))  # one row each
    return out.withColumn("passages_deduped", F.col("__all") - F.col("passages_emitted")).drop("__all")


def distributions(df: DataFrame) -> DataFrame:
    """dimension (language, flores_target, query_type), value and n of clean examples, in one pass; blanks are left out."""
    pairs = F.array(*(F.struct(F.lit(name).alias("dimension"), F.col(c).alias("value")) for name, c in (("language", "shard_lang"), ("flores_target", "target_lang"), ("query_type", "query_type"))))
    return df.select(F.inline(pairs)).where("value is not null and value != ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def with_gold(df: DataFrame) -> DataFrame:
    return df.withColumn("gold_document_ids", F.transform(F.filter("passages", lambda p: p["is_selected"]), lambda p: p["document_id"]))


def exploded(df: DataFrame) -> DataFrame:
    """One row per passage, in order, with the example's shard, split and query type."""
    return df.select("shard_lang", "split", "query_type", F.posexplode("passages").alias("seq", "p")).select("p.*", "shard_lang", "split", "query_type", "seq")


def first_passages(rows: DataFrame, order: list, scope: str = "global") -> DataFrame:
    """Passages of which no earlier one has the same language and text (case and spaces aside)."""
    key = [F.col("language"), X.dedupe_key(F.col("text")), *([F.col("shard_lang")] if scope == "per_lang" else [])]
    # A 128-bit hash stands for the text; tasks keep the first of each key that they have before anything is shuffled.
    null = [c.isNull() for c in key]
    rows = rows.withColumns({"__a": F.xxhash64(*key, *null), "__b": F.xxhash64(F.lit(7), *key, *null)})
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__a", "__b").orderBy(*order))).where("__n = 1").drop("__n", "__a", "__b")


def deduped(df: DataFrame, scope: str = "global") -> DataFrame:
    """Examples with only the first passage of each text; their gold ids are those that are left.

    Examples come in the order of shard, split, query_id and queries; those that agree in all of these,
    in the order read. Each is an example of its own: ids may repeat, within a shard and across splits.
    """
    # An example is its head (all but the passages, at place -1) and a row for each passage, put together again by number.
    others = [c for c in df.columns if c != "passages"]
    place = lambda p, i: F.struct(i.alias("seq"), p.alias("p"))
    none = F.lit(None).cast(df.schema["passages"].dataType.elementType)
    parts = F.concat(F.array(place(none, F.lit(-1))), F.transform("passages", place))
    rows = df.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.struct(*others).alias("__head"), F.inline(parts))
    head = F.col("seq") < 0
    key = [F.col("p.language"), X.dedupe_key(F.col("p.text")), *([F.col("__head.shard_lang")] if scope == "per_lang" else [])]
    null = [c.isNull() for c in key]
    # A 128-bit hash stands for the text; heads are keys of their own.
    rows = rows.withColumns({"__a": F.when(head, F.xxhash64("__row")).otherwise(F.xxhash64(*key, *null)), "__b": F.when(head, F.col("__row")).otherwise(F.xxhash64(F.lit(7), *key, *null))})
    order = [F.col(f"__head.{c}") for c in ("shard_lang", "split", "query_id", "eng_query", "query")]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__a", "__b", head).orderBy(*order, "__row", "seq"))).where("__n = 1")
    kept = F.collect_list(F.when(~head, F.struct("seq", "p")))
    out = rows.groupBy("__row").agg(F.first(F.when(head, F.col("__head")), ignorenulls=True).alias("__head"), F.transform(F.sort_array(kept), lambda x: x["p"]).alias("passages"))
    return with_gold(out.select(*(F.col(f"__head.{c}") if c != "passages" else F.col(c) for c in df.columns)))


def per_language(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each language, before any cleaning."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("shard_lang").orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def counts(df: DataFrame) -> DataFrame:
    """One row of totals and averages over clean examples."""
    n = F.count("*")
    size = F.size("passages")
    chars = F.aggregate("passages", F.lit(0).cast("long"), lambda a, p: a + p["char_length"])
    gold = F.size("gold_document_ids")
    mean = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 2)
    return df.agg(
        n.alias("examples"), F.sum(size).alias("passages"), F.sum(gold).alias("gold_passages"), F.count_if(gold == 0).alias("without_gold"),
        F.count_if(F.col("answer").isNull()).alias("without_answer"), mean(F.sum(size), n).alias("passages_per_example"), mean(F.sum(chars), F.sum(size)).alias("chars_per_passage"),
    )


def histogram(df: DataFrame, column: str, skip_blank: bool = False) -> DataFrame:
    rows = df.where(F.col(column).isNotNull() & (F.col(column) != "")) if skip_blank else df
    return rows.groupBy(column).agg(F.count("*").alias("n"))
