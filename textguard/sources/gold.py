"""Gold spans and scopes on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_GOLD = "doc_id string, unit_id string, start int, end int, category string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold JSON lines (doc_id, unit_id, ord, start, end, category); blank lines and those that begin with # are skipped.

    doc_id names the file; it is null in gold of a single one.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("ord"))
    rows = lines.where((F.col("v") != "") & ~F.col("v").startswith("#"))
    return rows.select(F.from_json("v", _GOLD).alias("g"), "ord").select("g.doc_id", "g.unit_id", "ord", "g.start", "g.end", "g.category")


def write_gold(gold: DataFrame, path: str) -> None:
    keys = [c for c in ("doc_id", "unit_id") if c in gold.columns]
    gold.orderBy(*keys, "start").select(*keys, "start", "end", "category").write.mode("overwrite").json(path)


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """Unit ids of a JSON array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("unit_id")).distinct()


def write_scope(units: DataFrame, path: str) -> None:
    """One JSON array of sorted unit ids, as a text file."""
    units.agg(F.to_json(F.array_sort(F.collect_set("unit_id"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def in_order(spans: DataFrame) -> DataFrame:
    """Spans with ord: their order by start within the unit."""
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy(*[c for c in ("doc_id", "unit_id") if c in spans.columns]).orderBy("start", "end")).cast("long"))
