"""Scratch tables on the shared file system: written, read back, deleted once no longer read.

They go below the folder the cluster names in ``spark.checkpoint.dir``, as plain Parquet, so a lost
executor never loses an intermediate result. A run's tables lie in one folder. A table that
a returned frame still reads cannot be deleted by its operator; ``sweep`` deletes all that this
application has left, once its results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a scratch table: what a writing task buffers.
BLOCK = 16 << 20
#: Folders that a task writes at a time, rather than sorting its rows by folder first.
WRITERS = 8
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. Only a local master, whose tasks share its disk, may do without one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="textguard-")
        _OWN[context.applicationId] = named
    return f"{named.rstrip('/')}/textguard-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch of this application; frames that read it are void afterwards."""
    delete(spark, scratch_dir(spark))


class Scratch:
    """Tables of one run in a folder of their own; leaving the ``with`` block deletes the folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count = spark, scratch_path(spark, label), 0

    def put(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write a frame and read it back: cuts lineage, survives executors. ``by`` names folder columns."""
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        held = self.spark.conf.get(_WRITERS)
        try:
            self.spark.conf.set(_WRITERS, str(WRITERS if by else held))
            df.write.option("parquet.block.size", BLOCK).partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(_WRITERS, held)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *raised) -> None:
        delete(self.spark, self.path)
