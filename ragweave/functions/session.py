"""Session settings and shared folders that plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def stable_unions(spark: SparkSession) -> None:
    """Let unions not pass on their children's partitioning, in this session.

    Adaptive execution may coalesce the children differently after the plan has counted on equal
    partition counts, which then fails when the plan runs.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is taken, but only for a master that runs
    everything on this machine.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ragweave-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, where several branches of a plan would compute it again.

    The table stays until ``release_settled``, as results read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragweave/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_ragweave_settled"):
        spark._ragweave_settled = []
    return spark._ragweave_settled


def release_settled(spark: SparkSession) -> None:
    """Delete the tables that ``settled`` wrote in this session: results that read them must have been written."""
    paths = _written(spark)
    while paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context, as ``--py-files`` would."""
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
