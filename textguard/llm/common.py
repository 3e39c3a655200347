"""Shared plumbing: tables, Arrow maps, fold rules, numbers of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.sources import workers
from textguard.sources.scratch import Scratch, scratch_path

__all__ = ["Scratch", "doc_crc", "materialize", "partitions", "row_key", "scratch_path", "small_batches", "table"]

#: Rows and bytes of one Arrow batch: bound the memory of a Python worker when texts are long.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Bytes of stored input to a task of a range shuffle.
TASK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to shared scratch and read it back: cuts lineage, survives executors."""
    return Scratch(df.sparkSession, label).put(df, label)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts may be very long, and let workers find this package.

    Lazy frames take these settings when they run, so they stay; all operators set the same values,
    and never above what the session has.
    """
    workers.ship(spark)
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        held = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("bB")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def doc_crc(col: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text, as the fold rules use it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


def row_key() -> Column:
    """A row's doc_id and text as 16 bytes, never null: what stands for the row where ids may repeat or lack."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.coalesce("text", F.lit(""))).cast("binary")))


def partitions(df: DataFrame) -> int:
    """How many ways to deal a range shuffle of ``df``: by its stored bytes, and as the session has it at least."""
    spark = df.sparkSession
    leaves, stored = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        size = int(str(leaves.apply(k).stats().sizeInBytes()))
        stored += size if size < 1 << 60 else 0  # unknown sizes are reported as the greatest number
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
