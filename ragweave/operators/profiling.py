"""Profiles of nested data whose schema nobody stated: JSON texts walked as VARIANT values to dotted paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a value that a profile shows.
PREVIEW = 80
#: Kinds of values by the first character of their JSON; others are numbers.
KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text go, those inside its strings aside; 0 for null and scalars."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    signs = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.coalesce(F.aggregate(signs, start, step, lambda acc: acc["most"]), F.lit(0))


def _sign(v: Column) -> Column:
    return F.substring(F.to_json(v), 1, 1)


def _entries() -> Column:
    """The entries (key, value) of a container that has not been counted yet; null for all else."""
    items = F.col("__v").cast("array<variant>")
    keyless = F.array_repeat(F.lit(None).cast("string"), F.size(items))
    fresh = F.col("__size").isNull()
    return F.when(fresh & (F.col("__of") == "{"), F.map_entries(F.col("__v").cast("map<string, variant>"))).when(fresh & (F.col("__of") == "["), F.arrays_zip(keyless.alias("key"), items.alias("value")).cast("array<struct<key: string, value: variant>>"))


def _opened(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (path, __of, __size, __v) and those of the entries of containers, which are then counted and let go of their values."""
    rows = rows.select(*by, "path", "__of", "__size", "__v", F.inline(F.array(F.struct(_entries().alias("__e")))))
    # The row itself comes first, with its entries' number as its key. Only short columns go along to each entry.
    own = F.struct(F.size("__e").cast("string").alias("key"), F.when(F.col("__e").isNull(), F.col("__v")).alias("value"))
    none = F.array().cast("array<struct<key: string, value: variant>>")
    rows = rows.withColumn("__counted", F.col("__e").isNotNull())
    rows = rows.select(*by, "path", "__of", "__size", "__counted", F.posexplode(F.concat(F.array(own), F.coalesce("__e", none))).alias("__i", "__x"))
    same, key = F.col("__i") == 0, F.col("__x.key")
    name = F.when(key.rlike(r'[.\[\]"]'), F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key)
    path = F.when(same, F.col("path")).when(F.col("__of") == "{", F.concat("path", F.lit("."), name)).otherwise(F.concat("path", F.lit("[]")))
    size = F.when(same & F.col("__counted"), key.cast("long")).when(same, F.col("__size"))
    return rows.select(*by, path.alias("path"), F.when(same, F.col("__of")).otherwise(_sign(F.col("__x.value"))).alias("__of"), size.alias("__size"), F.col("__x.value").alias("__v"))


def nested_profile(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """What the JSON texts of ``column`` hold, a row for each group of ``by``, dotted path and kind of value.

    Columns: path (``$`` is the whole, ``[]`` any element; names with dots, brackets or quotes stand in
    quotes), kind, n, n_empty (nulls, blank strings, containers without entries), least_size, most_size,
    total_size (characters of strings, entries of containers), least and greatest (first characters of
    scalars, in code point order). Null texts are of kind ``missing``; texts that aren't JSON, or give a
    name twice in one object, are ``malformed``. Rows of one path with several kinds show where types clash.

    The depth of the deepest text (one row for the driver) sets how many times containers are opened, one
    generator after another, so the texts are read twice and only partial sums by path and kind are shuffled.
    """
    by = by or []
    text = F.col(column)
    depth = df.agg(F.max(nesting(text))).head()[0] or 0
    rows = df.select(*by, F.lit("$").alias("path"), text.isNull().alias("__null"), F.inline(F.array(F.struct(F.try_parse_json(text).alias("__v")))))
    whole = F.when(F.col("__null"), "missing").when(F.col("__v").isNull(), "malformed").otherwise(_sign(F.col("__v")))
    rows = rows.select(*by, "path", whole.alias("__of"), F.lit(None).cast("long").alias("__size"), "__v")
    for _ in range(depth):
        rows = _opened(rows, by)
    of, v = F.col("__of"), F.col("__v")
    # Only strings are cast: a cast of another scalar is planned anew for each value, its JSON is not.
    t = F.when(of == '"', v.cast("string")).when(~of.isin("{", "[", "n", "missing", "malformed"), F.to_json(v))
    rows = rows.select(*by, "path", "__of", "__size", F.inline(F.array(F.struct(t.alias("t")))))
    kind = F.when(of.isin("missing", "malformed"), of)
    for sign, name in KINDS.items():
        kind = kind.when(of == sign, name)
    kind = kind.when(F.col("t").rlike("[.eE]"), "decimal").otherwise("integer")
    rows = rows.select(*by, "path", "t", kind.alias("kind"), F.when(of == '"', F.length("t").cast("long")).otherwise(F.col("__size")).alias("size"))
    kind, shown = F.col("kind"), F.substring("t", 1, PREVIEW)
    empty = kind.isin("null", "missing") | F.coalesce(F.col("size") == 0, F.lit(False)) | ((kind == "string") & (F.btrim("t") == ""))
    return rows.groupBy(*by, "path", "kind").agg(
        F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.sum("size").alias("total_size"),
        F.min(shown).alias("least"), F.max(shown).alias("greatest"),
    )


def merged(profiles: DataFrame) -> DataFrame:
    """One profile of several (of shards, of batches, of groups): what one run over all texts would give."""
    return profiles.groupBy("path", "kind").agg(
        F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty"), F.min("least_size").alias("least_size"), F.max("most_size").alias("most_size"), F.sum("total_size").alias("total_size"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
    )


def clashes(profile: DataFrame) -> DataFrame:
    """Paths that have values of more than one kind, nulls aside, with the kinds in order."""
    some = profile.where("kind not in ('null', 'missing')")
    return some.groupBy("path").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).where(F.size("kinds") > 1)
