"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are the ``\n``-separated parts of a text that have a word, compared as sequences of words.
Two lines are duplicates if they are equal, or if one word edit (inserted, deleted or replaced)
turns one into the other and is at most a fifth of the longer line, that is a similarity of 0.8 or
more. A line goes if an earlier line, by place and line number, is a duplicate of it; the earliest
of all stays. A place is a doc_id (null ids last) and then a hash of the text.

1. Equal lines meet under a 128-bit hash, and the earliest place is kept (partial sums first).
2. Lines within one edit agree before or after the edit, so they share the hash of their leading or
   trailing ``(m - 1) // 2`` words, m being the words of the longer. Lines that share neither with
   another distinct line have no neighbour. This drops no pair and leaves few lines to expand.
3. Every line that is left emits its deletion neighbourhood (itself and each variant with one word
   left out) as hashed keys. A line's key is the XOR of a hash of each word and its position, so
   all keys of a line come from one running XOR: n + 1 keys in linear time and memory. Equal
   variants with the same word left out are replacements, a variant equal to a whole line is an
   insertion. Each key's earliest line becomes the candidate of the others, so a group of any size
   gives one row per member, never pairs within it.
4. Candidates are verified by word edit distance.

Hot keys are pre-aggregated, and joins back to them are broadcast behind a size check or split by
adaptive execution. The texts are moved only if the lists of lines are beyond the checked size.

Defined results: null and blank texts have no lines and stay as they are; blank lines stay; rows
that share a doc_id but not the text are documents of their own, as are rows with a null id; of rows
equal in both doc_id and text the first keeps what is its own and the others lose every line; an
empty table gives no rows; extra columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import BLANK_CHARS, Tables, fence, hash128, join_checked, one_of_equals, words

#: Words of the longer line of a pair for each edit between them.
MIN_WORDS = 5
#: Words whose running XORs are built in one go.
BLOCK = 64


def _lines(docs: DataFrame, *ids: str) -> DataFrame:
    """One row per line: the columns ``ids`` and line_no, w (its words); lines without words are left out."""
    df = docs.select(*ids, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))
    return df.select(*ids, "line_no", words(F.col("line")).alias("w")).where(F.size("w") > 0)


def place_of(doc_id: Column, text: Column) -> Column:
    """What tells documents apart and orders them: null ids last, then the id, then a hash of the text."""
    return F.struct(doc_id.isNull().alias("last"), F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit(7), text)).alias("id"), F.xxhash64(text).alias("h"))


def _place(docs: DataFrame) -> DataFrame:
    return docs.select(place_of(F.col("doc_id"), F.col("text")).alias("place"), "text")


def _halves(w: Column) -> Column:
    """Hashes of the leading and of the trailing words that a line can share with a neighbour."""
    n = F.size(w)
    keys = []
    for m in (n, n + 1):  # the words of the longer line of a pair
        half = F.floor((m - 1) / 2).cast("int")
        keys += [F.xxhash64(m, F.lit(0), F.slice(w, F.lit(1), half)), F.xxhash64(m, F.lit(1), F.slice(w, n - half + 1, half))]
    return F.when(n >= MIN_WORDS - 1, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def one_edit(x: Column, y: Column) -> Column:
    """Whether one word inserted, deleted or replaced makes ``x`` equal to ``y`` (or they are equal)."""
    first = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    rest = lambda w, at: F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0)))
    same = (rest(x, first + 1) == rest(y, first + 1)) & (F.size(x) == F.size(y))
    more = rest(x, first + 1) == rest(y, first)
    less = rest(x, first) == rest(y, first + 1)
    return F.when(first == 0, F.lit(True)).otherwise(same | (more & (F.size(x) > F.size(y))) | (less & (F.size(y) > F.size(x))))


def _running_xor(df: DataFrame, *columns: str) -> DataFrame:
    """Replace arrays of longs, none empty, by their running XORs (each with itself and all before it).

    Blocks are scanned by themselves and then XORed with what stands before them.
    """
    last = lambda x: F.get(x, F.size(x) - 1)
    xored = lambda acc, x: F.concat(acc, F.array(x.bitwiseXOR(F.coalesce(last(acc), F.lit(0).cast("long")))))
    none, zero = F.array().cast("array<bigint>"), F.array(F.lit(0).cast("long"))

    def blocks(c: str) -> Column:
        starts = F.sequence(F.lit(1), F.size(c), F.lit(BLOCK))
        return F.transform(starts, lambda at: F.aggregate(F.slice(c, at, F.lit(BLOCK)), none, xored))

    df = fence(df, **{f"__{c}": blocks(c) for c in columns}).drop(*columns)
    df = fence(df, **{f"__{c}0": F.aggregate(f"__{c}", zero, lambda acc, x: F.concat(acc, F.array(last(acc).bitwiseXOR(last(x))))) for c in columns})

    def whole(c: str) -> Column:
        return F.flatten(F.transform(f"__{c}", lambda x, k: F.transform(x, lambda v: v.bitwiseXOR(F.get(F.col(f"__{c}0"), k)))))

    return fence(df, **{c: whole(c) for c in columns}).drop(*(f"__{c}{x}" for c in columns for x in ("", "0")))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """at, n, u, v and i for every line (at, w) and for each variant of it without the word i (-1: the line itself).

    u and v are a 128-bit hash of the words left. With g(k) the hash of word k at k, and s(k) that
    of word k at k - 1, the variant i is the XOR of g before i and s after i.
    """
    df = fence(lines, h=F.transform("w", lambda x: F.xxhash64(x))).drop("w")

    def at(seed: int) -> Column:
        return F.transform("h", lambda x, k: F.xxhash64(F.lit(seed), x, k))

    def moved(seed: int) -> Column:
        return F.transform("h", lambda x, k: F.xxhash64(F.lit(seed), x, k).bitwiseXOR(F.xxhash64(F.lit(seed), x, k - 1)))

    df = _running_xor(fence(df, g0=at(0), g1=at(1), m0=moved(0), m1=moved(1)).drop("h"), "m0", "m1")
    whole = {f"t{s}": F.aggregate(f"g{s}", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)) for s in (0, 1)}
    df = fence(df, **whole, n=F.size("g0"))
    shifted = {f"e{s}": F.col(f"t{s}").bitwiseXOR(F.get(f"m{s}", F.col("n") - 1)) for s in (0, 1)}
    df = fence(df, **shifted)
    key = lambda z, s: F.col(f"e{s}").bitwiseXOR(z[f"g{s}"]).bitwiseXOR(z[f"m{s}"])
    variants = F.transform(F.arrays_zip("g0", "g1", "m0", "m1"), lambda z, i: F.struct(key(z, 0).alias("u"), key(z, 1).alias("v"), i.alias("i")))
    itself = F.array(F.struct(F.col("t0").alias("u"), F.col("t1").alias("v"), F.lit(-1).alias("i")))
    return df.select("at", "n", F.inline(F.concat(itself, variants)))


def dropped_lines(docs: DataFrame, tables: Tables) -> DataFrame:
    """place, line_no and near (a neighbour, not an equal line, is earlier) of every line that goes; equal rows are one."""
    docs = _place(docs)
    a, b = hash128(F.col("w"))
    every = tables.write(_lines(docs, "place").select("place", "line_no", a.alias("a"), b.alias("b"), _halves(F.col("w")).alias("halves")))
    first = F.min(F.struct("place", "line_no"))
    distinct = tables.write(every.groupBy("a", "b").agg(first.alias("at"), F.count("*").alias("copies"), F.first("halves").alias("halves")))
    # Equal lines: all places but the first.
    repeated = tables.write(distinct.where("copies > 1").select("a", "b", "at"))
    equal = join_checked(every.select("a", "b", "place", "line_no"), repeated, ["a", "b"])
    equal = equal.where((F.col("place") != F.col("at.place")) | (F.col("line_no") != F.col("at.line_no"))).select("place", "line_no", F.lit(False).alias("near"))
    # Lines that can have a neighbour.
    halves = distinct.select("a", "b", "at", F.explode("halves").alias("half"))
    shared = tables.write(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"))
    some = tables.write(join_checked(halves, shared, "half", "left_semi").groupBy("a", "b").agg(F.first("at").alias("at")))
    # Their words, from the first place of each.
    where = tables.write(some.groupBy(F.col("at.place").alias("place")).agg(F.collect_set("at.line_no").alias("wanted")))
    texts = join_checked(docs, where, "place", array="wanted")
    rows = _lines(texts, "place", "wanted").where(F.array_contains("wanted", F.col("line_no")))
    kept = tables.write(rows.select(F.struct("place", "line_no").alias("at"), "w").dropDuplicates(["at"]))  # of equal rows any
    # The deletion neighbourhood of each.
    keys = tables.write(neighbourhood(kept))
    # Replacements leave out the word at the same place; insertions turn the longer into the other.
    by_place = keys.where((F.col("i") >= 0) & (F.col("n") >= MIN_WORDS)).groupBy("u", "v", "i").agg(F.min("at").alias("other"), F.count("*").alias("c"))
    by_place = tables.write(by_place.where("c > 1").select("u", "v", "i", "other"))
    longer = F.min(F.when((F.col("i") >= 0) & (F.col("n") >= MIN_WORDS), F.col("at")))
    by_whole = keys.groupBy("u", "v").agg(longer.alias("longer"), F.min(F.when(F.col("i") < 0, F.col("at"))).alias("whole"))
    by_whole = tables.write(by_whole.where("longer is not null and whole is not null"))
    replaced = join_checked(keys.where("i >= 0"), by_place, ["u", "v", "i"]).select("at", "other")
    inserted = join_checked(keys, by_whole, ["u", "v"]).select("at", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("whole")).alias("other"))
    pairs = tables.write(replaced.union(inserted).where(F.col("other") < F.col("at")).distinct())
    # Verified candidates.
    both = pairs.join(kept, "at").join(kept.select(F.col("at").alias("other"), F.col("w").alias("w2")), "other")
    near = both.where(one_edit(F.col("w"), F.col("w2"))).select("at").distinct().select("at.place", "at.line_no", F.lit(True).alias("near"))
    out = tables.write(equal.union(near))
    tables.keep_only(out)
    return out


def _marked(docs: DataFrame, tables: Tables) -> DataFrame:
    """``docs`` with ``__gone`` (lines that go, null if none do), ``__equal``, ``__near`` and ``__rows``, the rows with a word that are equal in doc_id and text (null: one)."""
    gone = dropped_lines(docs, tables)
    by = gone.groupBy("place").agg(F.sort_array(F.collect_set("line_no")).alias("__gone"), F.count_distinct(F.when(~F.col("near"), F.col("line_no"))).alias("__equal"), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("__near"))
    rows = _place(docs.where(_has_word(F.col("text")))).groupBy("place").agg(F.count("*").alias("__rows")).where("__rows > 1")
    by = tables.write(by.join(rows, "place", "full").withColumnRenamed("place", "__place"))
    place = place_of(docs["doc_id"], docs["text"])
    return join_checked(docs.withColumn("__at", place), by, F.col("__at") == F.col("__place"), "left", array="__gone").drop("__place")


def _first_of_equals(marked: DataFrame) -> DataFrame:
    return one_of_equals(marked.where("__rows is not null"), ["__at"], marked.columns)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK_CHARS)) != ""


def rest_of(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in ``gone``."""
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate lines taken out of each text.

    Documents that had words and have none left (every line of theirs stands in an earlier one) go.
    """
    tables = Tables(docs.sparkSession)
    marked = _marked(docs, tables)
    marked = marked.where("__rows is null").unionByName(_first_of_equals(marked))
    marked = marked.withColumn("__rest", rest_of(F.col("text"), F.col("__gone")))
    out = marked.where(F.col("__gone").isNull() | _has_word(F.col("__rest")))
    return out.select(*(F.col("__rest").alias(c) if c == "text" else F.col(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_lines (with words), n_equal and n_near taken out, gone (their numbers, comma-joined), rest_sha256."""
    tables = Tables(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = _marked(docs, tables)
    again = _first_of_equals(marked).withColumn("__again", F.explode(F.transform(F.sequence(F.lit(1), F.col("__rows").cast("int")), lambda k: k > 1)))
    marked = marked.where("__rows is null").withColumn("__again", F.lit(False)).unionByName(again)
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    marked = fence(marked, __lines=worded)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    every = F.size("__lines").cast("long")
    gone = F.when(F.col("__again"), F.col("__lines")).otherwise(F.coalesce("__gone", F.array().cast("array<int>")))
    return fence(marked, __out=gone).select(
        "doc_id", every.alias("n_lines"),
        F.when(F.col("__again"), every).otherwise(number("__equal")).alias("n_equal"),
        F.when(F.col("__again"), F.lit(0)).otherwise(number("__near")).cast("long").alias("n_near"),
        F.array_join(F.transform("__out", lambda i: i.cast("string")), ",").alias("gone"),
        F.sha2(rest_of(text, F.col("__out")), 256).alias("rest_sha256"),
    )


#: The same in DuckDB, where every row has an id of its own.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, k AS line_no, doc_id * 10000000 + k AS pos, regexp_extract_all(lines[k + 1], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS k FROM t)),
e AS (SELECT * FROM l WHERE len(w) > 0),
d AS (SELECT w, len(w) AS n, min(pos) AS pos FROM e GROUP BY w),
h AS (SELECT *, CASE side WHEN 0 THEN w[1:(m - 1) // 2] ELSE w[n - (m - 1) // 2 + 1:n] END AS half
  FROM (SELECT *, unnest([n, n + 1]) AS m FROM d), (VALUES (0), (1)) s(side)),
p AS (SELECT DISTINCT a.pos, a.w AS x, b.w AS y FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE a.pos > b.pos AND a.m >= 5 AND greatest(a.n, b.n) = a.m),
f AS (SELECT pos, x, y, coalesce(list_position(list_transform(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1]), true), 0) AS f FROM p),
near AS (SELECT DISTINCT pos FROM f WHERE f = 0 OR (len(x) = len(y) AND x[f + 1:] = y[f + 1:]) OR (len(x) > len(y) AND x[f + 1:] = y[f:]) OR (len(x) < len(y) AND x[f:] = y[f + 1:])),
g AS (SELECT doc_id, list(line_no ORDER BY line_no) AS gone, count(*) FILTER (e.pos <> d.pos) AS n_equal, count(*) FILTER (e.pos = d.pos) AS n_near
  FROM e JOIN d USING (w) WHERE e.pos <> d.pos OR e.pos IN (SELECT pos FROM near) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM e GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, coalesce(array_to_string(gone, ','), '') AS gone,
  sha256(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10))) AS rest_sha256
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)
"""
