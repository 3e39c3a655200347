"""Overlapping spans to disjoint ones: greedy by priority, length and place, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.spans import no_spans, overlap
from textguard.schema import PRIORITY


def priority(category: Column) -> Column:
    """Priority of a category; unknown ones have 0."""
    known = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.lit(0))


def resolve(spans: Column) -> Column:
    """Keep a span if it overlaps none kept before; ties keep the detectors' order; result by start."""
    ranked = F.transform(spans, lambda s, i: F.struct((-priority(s["category"])).alias("p"), (s["start"] - s["end"]).alias("l"), s["start"].alias("s"), i.alias("i"), s.alias("span")))
    ordered = F.transform(F.array_sort(ranked), lambda r: r["span"])
    kept = F.aggregate(ordered, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept)
