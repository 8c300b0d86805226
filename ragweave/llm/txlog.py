"""Transaction log reassembly.

Documents are log records in ascending doc_id; what a record is follows from a hash of its id: a
commit, an abort, a savepoint, a rollback, or a change of a key. A rollback keeps its savepoint, so a
change's fate hangs on two records of its source that come later: the next one that is no change
(a rollback there undoes it) and, if that is a savepoint, the next commit or abort.

The log is cut into chunks of consecutive ids. A chunk's summary has, for each source, its first
record that is no change and its first commit or abort: from before the chunk these are an unmatched
rollback, an opened savepoint or an end, and changes after the last of them are pending. "The first
of two summaries, where it has one" is associative, so a tree of blocks of chunks gives every chunk
what comes after it (``next_after``), and chunks are then resolved by themselves. Numbers of commits
and running totals of epochs come from the same kind of tree (``prefix_sums``). No task sees more of
a source than a chunk or a block has, and only the number of chunks and of commits goes to the driver.

Defined results: a null doc_id is no record and takes no part; records that share an id stand in the
order of source (code point, null last) and checksum (deletes first), equal ones one after the other;
a null source is a source; a null text, or any label with toxic 1 for the doc_id, deletes the key; an
empty text is stored like any other; labels without a document are ignored; without a commit there is
no epoch; an empty table gives no rows; columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm.common import Tables

KINDS = 17
EPOCH = 64
KEYS = 30_000
#: Records of a chunk; smaller inputs have a chunk for each shuffle partition.
CHUNK_ROWS = 1 << 20
#: Children of a node of the scans' trees.
FANOUT = 512


def records(docs: DataFrame, labels: DataFrame, keys: int = KEYS) -> DataFrame:
    """doc_id, src, op (X: change, S, R, C, A), key and v: the checksum of what a change stores, null if it deletes."""
    h = F.crc32(F.col("doc_id").cast("string"))
    kind = h % KINDS
    op = F.when(kind <= 1, "C").when(kind == 2, "A").when(kind <= 4, "S").when(kind <= 6, "R").otherwise("X")
    key = F.floor(h / 100) % keys
    df = docs.where("doc_id is not null").select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"), op.alias("op"), key.cast("long").alias("key"),
        F.when(op == "X", F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")))).alias("v"),
    )
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("__bad")).distinct()
    df = df.join(toxic.hint("merge"), F.col("doc_id") == F.col("__bad"), "left")
    return df.withColumn("v", F.when(F.col("__bad").isNull(), F.col("v"))).drop("__bad")


def chunked(log: DataFrame, tables: Tables, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The log as a table with its chunk numbers; a run of equal records may span chunks."""
    spark = log.sparkSession
    log = tables.write(log)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-log.count() // chunk_rows))
    order = [F.col("doc_id"), F.col("src") == "", F.col("src"), F.col("v"), F.col("salt")]
    cut = log.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    return tables.write(cut.withColumn("chunk", F.spark_partition_id().cast("long")))


def prefix_sums(df: DataFrame, at: str, columns: list[str], last: int, fanout: int = FANOUT) -> DataFrame:
    """Add before_{c}: the sum of each column over the rows with a smaller ``at`` (0 to ``last``, each once at most)."""
    inside = Window.partitionBy(F.floor(F.col(at) / fanout)).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("long") for c in columns})
    if last < fanout:
        return here
    block = f"{at}_block"
    blocks = df.groupBy(F.floor(F.col(at) / fanout).alias(block)).agg(*(F.sum(c).alias(c) for c in columns))
    up = prefix_sums(blocks, block, columns, last // fanout, fanout).select(block, *(F.col(f"before_{c}").alias(f"__{c}") for c in columns))
    out = here.withColumn(block, F.floor(F.col(at) / fanout)).join(up.hint("merge"), block)
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in columns}).drop(block, *(f"__{c}" for c in columns))


def next_after(df: DataFrame, by: str, at: str, columns: list[str], last: int, fanout: int = FANOUT) -> DataFrame:
    """Add next_{c}: each column's first value that isn't null among the rows of the same ``by`` with a greater ``at``."""
    inside = Window.partitionBy(by, F.floor(F.col(at) / fanout)).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumns({f"next_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    if last < fanout:
        return here
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c)
    block = f"{at}_block"
    blocks = df.groupBy(by, F.floor(F.col(at) / fanout).alias(block)).agg(*(first(c) for c in columns))
    up = next_after(blocks, by, block, columns, last // fanout, fanout).select(by, block, *(F.col(f"next_{c}").alias(f"__{c}") for c in columns))
    out = here.withColumn(block, F.floor(F.col(at) / fanout)).join(up.hint("merge"), [by, block])
    return out.withColumns({f"next_{c}": F.coalesce(F.col(f"next_{c}"), F.col(f"__{c}")) for c in columns}).drop(block, *(f"__{c}" for c in columns))


def fates(docs: DataFrame, labels: DataFrame, keys: int = KEYS, chunk_rows: int = CHUNK_ROWS, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Every change with its fate, and the number of commits.

    doc_id, key, v, kind (commit, abort, rollback), by (the id of the record that decides it; null at
    the log's end), rank (of the commit, from 1) and chunk, pos: the log's order.
    """
    tables = Tables(docs.sparkSession)
    log = chunked(records(docs, labels, keys), tables, chunk_rows)
    top = log.agg(F.max("chunk").alias("last"), F.count_if(F.col("op") == "C").alias("commits")).head()
    last = top["last"] or 0

    commits = log.groupBy("chunk").agg(F.count_if(F.col("op") == "C").alias("n"))
    before = prefix_sums(commits, "chunk", ["n"], last, fanout).select("chunk", "before_n")
    order = Window.partitionBy("chunk").orderBy("doc_id", F.col("src") == "", "src", F.col("v").asc_nulls_first(), "salt")
    df = log.join(before.hint("merge"), "chunk")
    df = df.withColumns({"pos": F.row_number().over(order), "rank": F.col("before_n") + F.count_if(F.col("op") == "C").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    record = F.struct("op", F.col("doc_id").alias("id"), "rank")
    df = df.withColumns({"mark": F.when(F.col("op") != "X", record), "end": F.when(F.col("op").isin("C", "A"), record)})
    # Falling order: what is seen last before a row in it is the first after the row in the log.
    later = Window.partitionBy("chunk", "src").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"mark_after": F.last("mark", ignorenulls=True).over(later), "end_after": F.last("end", ignorenulls=True).over(later)})
    df = tables.write(df.select("chunk", "src", "pos", "doc_id", "op", "key", "v", "mark", "end", "mark_after", "end_after"))
    tables.drop(log)

    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    summary = df.groupBy("src", "chunk").agg(first("mark"), first("end"))
    carried = tables.write(next_after(summary, "src", "chunk", ["mark", "end"], last, fanout).select("src", "chunk", "next_mark", "next_end"))

    changes = df.where("op = 'X'").drop("mark", "end").join(carried.hint("merge"), ["src", "chunk"])
    mark, end = F.coalesce("mark_after", "next_mark"), F.coalesce("end_after", "next_end")
    decided = F.when(mark["op"] == "S", end).otherwise(mark)
    kind = F.when(decided["op"] == "R", "rollback").when(decided["op"] == "C", "commit").otherwise("abort")
    out = changes.select("doc_id", "key", "v", kind.alias("kind"), decided["id"].alias("by"), decided["rank"].alias("rank"), "chunk", "pos")
    return tables.write(out), top["commits"]


def epochs(changes: DataFrame, commits: int, every: int = EPOCH, fanout: int = FANOUT) -> DataFrame:
    """epoch (from 1), n and total: the stored keys after each epoch and the sum of their checksums."""
    spark = changes.sparkSession
    n = -(-commits // every)
    when = F.struct("rank", "chunk", "pos")
    written = changes.where("kind = 'commit'").groupBy(F.floor((F.col("rank") - 1) / every).alias("e"), "key").agg(F.max_by(F.struct("v"), when)["v"].alias("v"))
    earlier = F.lag("v").over(Window.partitionBy("key").orderBy("e"))
    deltas = written.withColumns({"dn": F.col("v").isNotNull().cast("long"), "was": earlier})
    deltas = deltas.groupBy("e").agg(F.sum(F.col("dn") - F.col("was").isNotNull().cast("long")).alias("n"), F.sum(F.coalesce("v", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("total"))
    every_one = spark.range(n).withColumnRenamed("id", "e").join(deltas.hint("merge"), "e", "left").fillna(0, ["n", "total"])
    sums = prefix_sums(every_one, "e", ["n", "total"], max(n - 1, 0), fanout)
    return sums.select((F.col("e") + 1).alias("epoch"), (F.col("before_n") + F.col("n")).alias("n"), (F.col("before_total") + F.col("total")).alias("total"))


def stored(changes: DataFrame) -> DataFrame:
    """key, doc_id and v of the store at the log's end: the document of the last write of each key that isn't a delete."""
    last = F.max_by(F.struct("doc_id", "v"), F.struct("rank", "chunk", "pos"))
    return changes.where("kind = 'commit'").groupBy("key").agg(last.alias("w")).where("w.v is not null").select("key", "w.doc_id", "w.v")


def report(docs: DataFrame, labels: DataFrame, chunk_rows: int = CHUNK_ROWS, fanout: int = FANOUT) -> DataFrame:
    """kind, id, n, value: the store after each epoch, and every undone change."""
    changes, commits = fates(docs, labels, KEYS, chunk_rows, fanout)
    undone = changes.where("kind != 'commit'").select("kind", F.col("doc_id").cast("long").alias("id"), F.col("by").cast("long").alias("n"), F.col("key").alias("value"))
    states = epochs(changes, commits, EPOCH, fanout).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return states.unionByName(undone)


def _crc(x: str) -> str:
    """DuckDB's missing checksum of a text: the byte table of the polynomial, folded over the bytes."""
    byte = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)".format(x)
    return f"xor(list_reduce([4294967295::BIGINT] || {byte}, lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295)"


#: The same in DuckDB.
ORACLE = f"""
WITH tab AS (SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) r(i)),
h AS (SELECT doc_id, source, text, {_crc('doc_id::VARCHAR')} AS h FROM documents, tab WHERE doc_id IS NOT NULL),
rec AS (SELECT doc_id, source, text, CASE WHEN h % 17 <= 1 THEN 'C' WHEN h % 17 = 2 THEN 'A' WHEN h % 17 <= 4 THEN 'S' WHEN h % 17 <= 6 THEN 'R' ELSE 'X' END AS op, (h // 100) % 30000 AS key FROM h),
log AS (SELECT doc_id, source, op, key, CASE WHEN op = 'X' AND text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN {_crc("(key || ':' || text)")} END AS v FROM rec, tab),
ranked AS (SELECT *, count(*) FILTER (op = 'C') OVER (ORDER BY doc_id) AS rank FROM log),
marked AS (SELECT *, CASE WHEN op <> 'X' THEN {{'op': op, 'id': doc_id, 'rank': rank}} END AS m, CASE WHEN op IN ('C', 'A') THEN {{'op': op, 'id': doc_id, 'rank': rank}} END AS e FROM ranked),
after AS (SELECT *, first_value(m IGNORE NULLS) OVER w AS mark, first_value(e IGNORE NULLS) OVER w AS done FROM marked WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
fate AS (SELECT doc_id, key, v, CASE WHEN mark.op = 'S' THEN done ELSE mark END AS d FROM after WHERE op = 'X'),
es AS (SELECT unnest(range(1, CAST(ceil((SELECT count(*) FROM log WHERE op = 'C') / 64) AS BIGINT) + 1)) AS e),
store AS (SELECT e, key, max_by({{'v': v}}, (d.rank, doc_id)) AS w FROM es JOIN fate ON d.op = 'C' AND (d.rank - 1) // 64 < e GROUP BY e, key)
SELECT 'state' AS kind, es.e AS id, count(w.v) AS n, CAST(coalesce(sum(w.v), 0) AS BIGINT) AS value FROM es LEFT JOIN store ON store.e = es.e GROUP BY es.e
UNION ALL SELECT CASE WHEN d.op = 'R' THEN 'rollback' ELSE 'abort' END, doc_id, d.id, key FROM fate WHERE d IS NULL OR d.op <> 'C'
"""
