"""The redaction lifecycle: units -> spans -> digests and replacements -> rewritten text, audit.

A unit's spans, digests and replacements stay in its row from detection to rewriting, so nothing depends on
ids being there or being unique. Detection runs once: its rows are written to shared scratch, those with
spans apart from those without, and the latter are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.registry import raw_spans, with_name_patterns
from textguard.functions.spans import no_spans
from textguard.operators import audit, pseudonym
from textguard.operators.resolve import resolve
from textguard.operators.rewrite import rewrite_runs, splice
from textguard.schema import Settings
from textguard.sources.scratch import Scratch, delete


@dataclass
class Redaction:
    """What a run yields, all lazily from its rows."""

    rows: DataFrame  # the units' columns and spans: disjoint, with entity_id and replacement
    settings: Settings
    scratch: str | None = None  # folder that the rows are read from

    @property
    def units(self) -> DataFrame:
        return self.rows.drop("spans")

    @property
    def spans(self) -> DataFrame:
        """doc_id, unit_id, ordinal, start, end, text, category, detector, confidence, entity_id, replacement."""
        return self.rows.select("doc_id", "unit_id", "ordinal", F.explode("spans").alias("s")).select("doc_id", "unit_id", "ordinal", "s.*")

    def texts(self) -> DataFrame:
        """doc_id, unit_id, ordinal, redacted_text of every unit, those without spans unchanged."""
        return self._rewritten().select("doc_id", "unit_id", "ordinal", "redacted_text")

    def runs(self) -> DataFrame:
        """doc_id, unit_id, texts: new run texts of the units that change."""
        fresh = rewrite_runs(F.col("text"), F.col("runs"), F.col("spans"))
        return self.rows.where(F.size("spans") > 0).select("doc_id", "unit_id", F.transform(fresh, lambda r: r["text"]).alias("texts"))

    def audit(self) -> DataFrame:
        return audit.events(self.spans)

    def summary(self) -> DataFrame:
        return audit.summary(self.spans)

    def leaks(self) -> DataFrame:
        return audit.leaks(self._rewritten())

    def close(self) -> None:
        """Delete the run's scratch; what it yields cannot be read any more."""
        if self.scratch:
            delete(self.rows.sparkSession, self.scratch)

    def _rewritten(self) -> DataFrame:
        return self.rows.withColumn("redacted_text", F.when(F.size("spans") > 0, splice(F.col("text"), F.col("spans"))).otherwise(F.col("text")))


def text_units(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One unit per row of a text table; ids may be null or repeated."""
    return table.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit("body-0").alias("unit_id"), F.lit(0).alias("ordinal"), F.col(text).alias("text"))


def line_units(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One unit per line of a text table."""
    lines = table.select(F.col(doc_id).cast("string").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("ordinal", "text"))
    return lines.select("doc_id", F.format_string("body-%d", "ordinal").alias("unit_id"), "ordinal", "text")


def detect(units: DataFrame, settings: Settings) -> DataFrame:
    """``units`` with their disjoint spans, none in blank ones. Only names need more than the row."""
    names = None
    if "NAME" in settings.categories:
        units, names = with_name_patterns(units), (F.col("__names"), F.col("__pattern"))
    found = F.when(F.col("text").rlike(r"(?U)\S"), resolve(raw_spans(F.col("text"), settings, names))).otherwise(no_spans())
    return units.withColumn("spans", found).drop("__names", "__pattern")


def _marked(settings: Settings):
    """A span with its digest and the replacement that its own spelling shapes."""

    def mark(s: Column) -> Column:
        digest = pseudonym.entity_id(s["category"], s["text"], settings.salt)
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "text", "category", "detector", "confidence")], digest.alias("entity_id"))

    def replaced(s: Column) -> Column:
        return s.withField("replacement", pseudonym.replacement(s["category"], s["text"], s["entity_id"], settings.anchor_date))

    return lambda spans: F.transform(F.transform(spans, mark), replaced)


def span_rows(found: DataFrame, settings: Settings) -> DataFrame:
    """A row per span, with its digest."""
    rows = found.select("doc_id", "unit_id", "ordinal", F.explode("spans").alias("s")).select("doc_id", "unit_id", "ordinal", "s.*")
    return rows.withColumn("entity_id", pseudonym.entity_id(F.col("category"), F.col("text"), settings.salt))


def redact(units: DataFrame, settings: Settings | None = None, layout: str = "first_seen") -> Redaction:
    """Detect, map and prepare the rewrite of all units.

    ``layout`` says whose spelling shapes a replacement: that of the entity's first occurrence, or
    of each ``own`` occurrence (row by row, nothing written or shuffled). Only entities whose spellings
    call for several replacements are looked up; all others are what their own occurrence gives.
    """
    settings = settings or Settings()
    found = detect(units, settings)
    marked = found.withColumn("spans", _marked(settings)(F.col("spans")))
    if layout == "own":
        return Redaction(marked, settings)
    store = Scratch(units.sparkSession, "redact")
    numbered = marked.withColumns({"__row": F.monotonically_increasing_id(), "__hit": F.size("spans") > 0})
    rows = store.put(numbered, "rows", ("__hit",))
    hits = rows.where("__hit")
    spans = hits.select("__row", "doc_id", "ordinal", F.posexplode("spans").alias("at", "s")).select("__row", "doc_id", "ordinal", "at", "s.*")
    # entities are few against spans after the partial aggregation; a common one is split by the join's skew handling
    other = spans.join(pseudonym.first_replacements(spans), ["entity_id", "category"]).where(F.col("replacement") != F.col("first"))
    fixes = other.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("__fixes"))
    fixed = F.transform("spans", lambda s, i: s.withField("replacement", F.coalesce(F.try_element_at("__fixes", i), s["replacement"])))
    met = hits.join(fixes, "__row", "left").withColumn("spans", F.when(F.col("__fixes").isNull(), F.col("spans")).otherwise(fixed))
    every = met.select(*marked.columns).unionByName(rows.where(~F.col("__hit")).select(*marked.columns))
    return Redaction(every, settings, store.path)


def redact_rows(units: DataFrame, settings: Settings) -> DataFrame:
    """``units`` with redacted_text and events, row by row: no shuffle, fit for streams.

    Names need a knowledge base of whole documents and are left out here.
    """
    local = settings.only(c for c in settings.categories if c != "NAME")
    made = detect(units, local).withColumn("spans", _marked(local)(F.col("spans")))
    event = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "category", "entity_id", "replacement")])
    made = made.withColumn("events", F.transform("spans", event)).drop("spans")
    return made.withColumn("redacted_text", F.when(F.size("events") > 0, splice(F.col("text"), F.col("events"))).otherwise(F.col("text")))
