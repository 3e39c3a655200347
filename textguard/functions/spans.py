"""Spans from regular expressions, with code-point offsets, inside one row and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.schema import SPAN

#: What a match is to hooks: its value, start and end, and the text around it.
Hook = Callable[[Column, Column, Column, Column], Column]


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def no_matches() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str | Column) -> Column:
    """All non-overlapping matches, left to right: array of (start, end, text).

    What lies between the matches gives the offsets; patterns never match empty.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    zero = F.struct(F.lit(0).alias("at"), no_matches().alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def paired(hits: Column) -> Column:
        gaps = F.slice(F.split(text, p, -1), F.lit(1), F.size(hits))
        return F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    # splitting runs the pattern once more: only texts with a match need it
    fold = lambda hits: F.when(F.size(hits) == 0, no_matches()).otherwise(F.aggregate(paired(hits), zero, step, lambda acc: acc["out"]))
    return let(F.regexp_extract_all(text, p, F.lit(0)), fold)


def span_extract(text: Column, pattern: str | Column, category: str, detector: str, confidence: float, *, when: Column | None = None, keep: Hook | None = None, trim: Hook | None = None) -> Column:
    """Array of spans. ``when`` must hold for any text with a match; ``trim`` gives (start, end, text)."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["text"], m["start"], m["end"], text))
    if trim is not None:
        found = F.transform(found, lambda m: trim(m["text"], m["start"], m["end"], text))
    spans = tagged(found, category, detector, confidence)
    return spans if when is None else F.when(when, spans).otherwise(no_spans())


def tagged(found: Column, category: str, detector: str, confidence: float) -> Column:
    """Category, detector and confidence put on (start, end, text) structs."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(category).alias("category"), F.lit(detector).alias("detector"), F.lit(confidence).alias("confidence"))).cast(f"array<{SPAN}>")


def cut(value: Column, start: Column, left: Column, right: Column) -> Column:
    """(start, end, text) of a match shortened by so many code points on either side."""
    text = F.substring(value, left + 1, F.length(value) - left - right)
    return F.struct((start + left).alias("start"), (start + F.length(value) - right).alias("end"), text.alias("text"))


def overlap(a: Column, b: Column) -> Column:
    """Touching spans do not overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")
