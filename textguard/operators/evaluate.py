"""Predictions against gold spans: greedy one-to-one matches, P/R/F1, character accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.schema import CATEGORIES

_PAIR = "array<struct<ord:long,start:int,end:int>>"


def _unit(*frames: DataFrame) -> Column:
    """What tells units apart: doc_id too where all frames have it. A struct, so that null ids equal each other."""
    return F.struct(*[c for c in ("doc_id", "unit_id") if all(c in f.columns for f in frames)]).alias("unit")


def _within(frames: list[DataFrame], scope: DataFrame | None) -> list[DataFrame]:
    """Frames restricted to the units of a scope; an empty one counts as none."""
    if scope is None or scope.limit(1).isEmpty():
        return frames
    unit = _unit(scope, *frames)
    units = scope.select(unit).distinct()
    return [f.withColumn("unit", unit).join(units, "unit", "left_semi").drop("unit") for f in frames]


def matched(preds: Column, golds: Column, mode: str) -> Column:
    """Number of golds that find a prediction of their own.

    Golds go in order; each takes the unused prediction of greatest score, the first on
    ties. Any mode but ``strict`` counts shared characters.
    """

    def score(p: Column, g: Column) -> Column:
        if mode == "strict":
            return F.when((p["start"] == g["start"]) & (p["end"] == g["end"]), 1).otherwise(0)
        return F.greatest(F.lit(0), F.least(p["end"], g["end"]) - F.greatest(p["start"], g["start"]))

    def step(used: Column, g: Column) -> Column:
        scored = F.transform(preds, lambda p, i: F.struct(score(p, g).alias("s"), (-i).alias("i")))
        free = F.filter(scored, lambda x: (x["s"] > 0) & ~F.array_contains(used, -x["i"]))
        return F.when(F.size(free) > 0, F.concat(used, F.array(-F.array_max(free)["i"]))).otherwise(used)

    return F.aggregate(golds, F.array().cast("array<int>"), step, F.size)


def counts(predictions: DataFrame, gold: DataFrame, mode: str = "overlap", categories=CATEGORIES, scope: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn of every category in force, those without spans included.

    Both inputs: unit_id (and doc_id, where units of several documents are judged), ord (input order),
    start, end, category. A scope (unit_id, doc_id) restricts both; an empty one counts as none.
    """
    predictions, gold = _within([predictions, gold], scope)
    unit = _unit(predictions, gold)

    def grouped(spans: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "start", "end")))
        return spans.where(F.col("category").isin(*categories)).groupBy(unit, "category").agg(rows.alias(name))

    both = grouped(predictions, "p").join(grouped(gold, "g"), ["unit", "category"], "full_outer")
    p, g = (F.coalesce(F.col(c), F.array().cast(_PAIR)) for c in ("p", "g"))
    rows = both.select("category", p.alias("p"), g.alias("g")).select("category", F.size("p").alias("n_p"), F.size("g").alias("n_g"), matched(F.col("p"), F.col("g"), mode).alias("tp"))
    sums = rows.groupBy("category").agg(F.sum("tp").alias("tp"), F.sum(F.col("n_p") - F.col("tp")).alias("fp"), F.sum(F.col("n_g") - F.col("tp")).alias("fn"))
    spark = predictions.sparkSession
    known = spark.createDataFrame([(c,) for c in categories], "category string")
    return known.join(sums, "category", "left").na.fill(0, ["tp", "fp", "fn"])


def with_ratios(rows: DataFrame) -> DataFrame:
    """support, precision, recall and f1; null where undefined (f1 also where either is 0)."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    return rows.withColumns({"support": F.col("tp") + F.col("fn"), "precision": p, "recall": r, "f1": f1})


def metrics(predictions: DataFrame, gold: DataFrame, mode: str = "overlap", categories=CATEGORIES, scope: DataFrame | None = None) -> DataFrame:
    """Per category, and the micro average as category MICRO."""
    by = counts(predictions, gold, mode, categories, scope)
    total = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("MICRO").alias("category"), "tp", "fp", "fn")
    return with_ratios(by.unionByName(total))


def character_accuracy(predictions: DataFrame, gold: DataFrame, lengths: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Share of characters on which both sides agree to be personal data or not; one row.

    ``lengths``: unit_id (and doc_id), n. Spans of any category count, clamped to the unit. Without
    characters the accuracy is 1.
    """
    unit = _unit(predictions, gold, lengths)
    units = _within([lengths.where(F.col("n") > 0)], scope)[0].withColumn("unit", unit)

    def mask(spans: DataFrame, name: str) -> DataFrame:
        return spans.groupBy(unit).agg(F.collect_list(F.struct("start", "end")).alias(name))

    def covered(spans: Column, n: Column) -> Column:
        inside = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")), lambda s: s["start"] < F.least(s["end"], n))
        return F.array_distinct(F.flatten(F.transform(inside, lambda s: F.sequence(s["start"], F.least(s["end"], n) - 1))))

    n = F.col("n").cast("int")
    rows = units.join(mask(predictions, "p"), "unit", "left").join(mask(gold, "g"), "unit", "left").select("n", covered(F.col("p"), n).alias("p"), covered(F.col("g"), n).alias("g"))
    differ = F.size(F.array_except("p", "g")) + F.size(F.array_except("g", "p"))
    total = rows.agg(F.sum(F.col("n") - differ).cast("long").alias("correct"), F.sum("n").cast("long").alias("total"))
    filled = total.na.fill(0)
    return filled.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), F.lit(1.0)))


def render(rows: DataFrame, mode: str, accuracy: float) -> str:
    """The report in Markdown; ten rows at most come to the driver."""
    found = {r["category"]: r for r in rows.collect()}
    shown = lambda x: "n/a" if x is None else f"{x:.3f}"
    line = lambda label, r: f"| {label} | {r['tp']} | {r['fp']} | {r['fn']} | {shown(r['precision'])} | {shown(r['recall'])} | {shown(r['f1'])} | {r['support']} |"
    out = ["# Evaluation Report", "", f"Span-match mode: **{mode}**", "", "| Category | TP | FP | FN | Precision | Recall | F1 | Support |", "|---|---|---|---|---|---|---|---|"]
    for category in (c for c in CATEGORIES if c in found):
        r = found[category]
        absent = not r["support"] and not r["fp"]
        out.append(f"| {category} | 0 | 0 | 0 | n/a | n/a | n/a | 0 (not present) |" if absent else line(category, r))
    out += [line("**Overall (micro)**", found["MICRO"]), "", f"Character accuracy: **{accuracy:.4f}** (for completeness; most characters are never personal data)."]
    return "\n".join(out)
