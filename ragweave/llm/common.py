"""Shared pieces of the corpus operators: shared-folder tables, checked broadcasts, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions.session import shared_dir, stable_unions

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only while it has at most so many rows (a few longs each).
BROADCAST_ROWS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context (as ``--py-files`` would), and set up the session."""
    stable_unions(spark)
    context = spark.sparkContext
    if getattr(context, "_ragweave_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ragweave-"), "ragweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._ragweave_shipped = True


#: Folders that operators have opened, in order.
_OPENED: list[str] = []


def opened() -> int:
    """A mark for ``release``."""
    return len(_OPENED)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete all tables that operators have written since ``mark``: results that read them must have been written."""
    while len(_OPENED) > mark:
        _delete(spark, _OPENED.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    An operator's result reads some of them lazily, so they stay until ``release``.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ragweave/{uuid.uuid4().hex}"
        self.n = 0
        self.live: list[DataFrame] = []
        _OPENED.append(self.root)

    def write(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return a reader of it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ragweave_path = path
        self.live.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        gone = {df._ragweave_path for df in tables}
        for path in gone:
            _delete(self.spark, path)
        self.live = [df for df in self.live if df._ragweave_path not in gone]

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {df._ragweave_path for df in tables}
        self.drop(*(df for df in self.live if df._ragweave_path not in kept))


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """Join with ``small`` (a written table): broadcast it if it has at most ``rows`` rows, and as many entries in its column ``array``.

    Beyond that both sides are shuffled, and adaptive execution splits skewed partitions.
    """
    few = small.count() <= rows
    if few and array:
        few = (small.agg(F.sum(F.greatest(F.size(array), F.lit(0)))).head()[0] or 0) <= rows
    return left.join(F.broadcast(small) if few else small, on, how)


def words(col: Column) -> Column:
    """The words of a text in order; none for null or blank texts."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, which the optimizer doesn't merge projections across.

    Higher-order functions evaluate what a lambda refers to once per element, so an array
    that lambdas index must be a column of its own, not an expression copied into them.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def one_of_equals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row for each value of ``by``: of several the one with the least hash of all columns that can be hashed."""
    kinds = dict(df.dtypes)
    order = F.xxhash64(*(c for c in columns if "map<" not in kinds[c] and kinds[c] != "variant"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("__one")).select("__one.*")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values, with different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
