"""Detectors in force, in the order that settles exact ties; more can be registered.

A detector is a function from the text column to an array of spans. Python detectors come
in through ``python_detector``; the optional entity recogniser is one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import entities
from textguard.functions.detectors import STRUCTURED
from textguard.functions.spans import no_spans
from textguard.schema import SPAN, Settings

Detector = Callable[[Column], Column]
_EXTRA: dict[str, Detector] = {}


def register(name: str, detector: Detector) -> None:
    """Add a detector; it runs after the built-in ones, in order of registration."""
    _EXTRA[name] = detector


def unregister(name: str) -> None:
    _EXTRA.pop(name, None)


def python_detector(find: Callable[[str], list[tuple[int, int, str]]], detector: str, confidence: float) -> Detector:
    """A detector from a Python function text -> [(start, end, category)], in Arrow batches."""
    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [(s, e, t[s:e], c, detector, confidence) for s, e, c in find(t)])

    return spans


def ner_detector(categories: tuple[str, ...], model: str) -> Detector | None:
    """The optional entity recogniser; None where library or model is missing."""
    try:
        import spacy

        spacy.load(model)
    except Exception:  # any failure to load means: run without it
        return None
    label = {"PERSON": "NAME", "ORG": "COMPANY", "GPE": "ADDRESS", "LOC": "ADDRESS", "FAC": "ADDRESS"}
    loaded: list = []

    def find(text: str) -> list[tuple[int, int, str]]:
        if not loaded:
            loaded.append(spacy.load(model, disable=["lemmatizer", "tagger", "parser"]))
        found = [(e.start_char, e.end_char, label.get(e.label_)) for e in loaded[0](text).ents]
        return [x for x in found if x[2] in categories]

    return python_detector(find, "spacy.ner", 0.6)


def raw_spans(text: Column, settings: Settings, names: tuple[Column, Column] | None = None) -> Column:
    """All detectors' spans, one after the other; disabled categories are not even built. ``names``: the document's persons and their pattern."""
    on = settings.categories
    found = [detect(text) for category, detect in STRUCTURED.items() if category in on]
    if "NAME" in on and names is not None:
        found.append(entities.name(text, *names))
    if "COMPANY" in on:
        found.append(entities.company(text, settings.company_allowlist))
    if "ADDRESS" in on:
        found.append(entities.address(text))
    if settings.use_ner and (ner := ner_detector(tuple(c for c in ("NAME", "COMPANY", "ADDRESS") if c in on), settings.ner_model)):
        found.append(ner(text))
    found += [detect(text) for detect in _EXTRA.values()]
    return F.concat(*found) if found else no_spans()


def with_name_patterns(units: DataFrame) -> DataFrame:
    """``units`` with their document's persons and their pattern as __names and __pattern (null without persons).

    A unit without a doc_id is a document of its own.
    """
    owner = F.coalesce(F.col("doc_id"), F.concat(F.lit("\0"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    owned = units.withColumn("__doc", owner)
    known = entities.name_patterns(entities.knowledge_base(owned.drop("doc_id").withColumnRenamed("__doc", "doc_id")))
    return owned.join(known.select(F.col("doc_id").alias("__doc"), F.col("names").alias("__names"), F.col("name_pattern").alias("__pattern")), "__doc", "left").drop("__doc")
