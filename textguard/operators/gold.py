"""Gold spans built from annotated substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_gold(annotations: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, problems) from annotations (unit_id, ordinal, category, substring).

    Each substring takes its first occurrence in the unit that overlaps none taken before.
    A missing unit or substring is a problem (unit_id, ordinal, reason), not an error.
    """
    listed = annotations.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "substring"))).alias("items"))
    met = listed.join(units.select("unit_id", "text"), "unit_id", "left")
    taken = "array<struct<ordinal:int,start:int,end:int,category:string>>"

    def place(acc: Column, item: Column, text: Column) -> Column:
        size = F.length(item["substring"])
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0))), lambda p: F.substring(text, p + 1, size) == item["substring"])
        free = F.filter(starts, lambda p: ~F.exists(acc, lambda k: (k["start"] < p + size) & (p < k["end"])))
        at = F.get(free, F.lit(0))
        span = F.struct(item["ordinal"].alias("ordinal"), at.alias("start"), (at + size).alias("end"), item["category"].alias("category"))
        return F.when(at.isNotNull() & (size > 0), F.concat(acc, F.array(span))).otherwise(acc)

    text = F.coalesce("text", F.lit(""))
    spans = F.aggregate("items", F.array().cast(taken), lambda acc, item: place(acc, item, text))
    found = met.withColumn("spans", F.when(F.col("text").isNotNull(), spans).otherwise(F.array().cast(taken)))
    gold = found.select("unit_id", F.explode("spans").alias("s")).select("unit_id", "s.ordinal", "s.start", "s.end", "s.category")
    every = found.select("unit_id", "text", F.explode("items").alias("i"), "spans").where(~F.exists("spans", lambda s: s["ordinal"] == F.col("i.ordinal")))
    reason = F.when(F.col("text").isNull(), "unit is missing").otherwise("substring is missing")
    return gold, every.select("unit_id", F.col("i.ordinal").alias("ordinal"), reason.alias("reason"))
