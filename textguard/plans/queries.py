"""Registered queries of the engine over the driver's tables, and their SQL counterparts.

Structured categories run over ``documents``. The categories that it lacks run over profile
texts built in SQL from ``customer``: each row is a prefix, a value and a suffix, so its spans are
known from the construction, with rows that must yield nothing among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import entities, registry
from textguard.functions.detectors import STRUCTURED
from textguard.functions.spans import span_extract
from textguard.operators import evaluate, gold
from textguard.operators.resolve import resolve
from textguard.operators.rewrite import rewrite_runs, run_offsets
from textguard.plans import sql as S
from textguard.plans.redact import detect, redact, span_rows, text_units
from textguard.schema import Settings
from textguard.sources.gold import in_order
from textguard.streaming import redact as stream

#: Policy of the registered queries; the salt is public on purpose, so that SQL can check digests.
POLICY = Settings()
STRUCTURED_POLICY = POLICY.only(("EMAIL", "PHONE", "CREDIT_CARD", "IP"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units(_table(spark, sf_dir, "documents"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units (doc_id, unit_id, ordinal, text) of the profile texts."""
    rows = spark.sql(S.PROFILES, customer=_table(spark, sf_dir, "customer"))
    return rows.select("doc_id", F.concat(F.lit("body-"), F.col("ordinal").cast("string")).alias("unit_id"), "ordinal", F.concat("pre", "val", "post").alias("text"))


def _listed(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "ordinal", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("value"))


def _document_spans(category: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = _documents(spark, sf_dir)
        return _listed(units.select("doc_id", "ordinal", F.explode(STRUCTURED[category](F.col("text"))).alias("s"))).drop("ordinal")

    return query


def _profile_spans(detector):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = _profiles(spark, sf_dir)
        return _listed(units.select("doc_id", "ordinal", F.explode(detector(F.col("text"))).alias("s")))

    return query


def name_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and aliases mined from the tables of documents built from ``customer``: one with names and roles, one without roles."""
    return entities.with_aliases(entities.mine_tables(spark.sql(S.CELLS, customer=_table(spark, sf_dir, "customer"))))


def registered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector registered from outside, beside the built-in ones: customers' numbers."""
    names = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("body-0").alias("unit_id"), F.lit(0).alias("ordinal"), F.concat(F.lit("see "), "c_name", F.lit(" at 10.0.0.1")).alias("text"))
    registry.register("customers", lambda text: span_extract(text, r"Customer#[0-9]+", "CUSTOMER", "registered.customer", 0.8))
    try:
        found = detect(names, POLICY.only(("IP",))).select("doc_id", F.explode("spans").alias("s"))
    finally:
        registry.unregister("customers")
    return found.select("doc_id", F.col("s.category").alias("category"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("value"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form over ``documents`` as a static frame: redactions by category and five minutes of event time."""
    stamped = _documents(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("doc_id").cast("long") * 7))
    counts = stream.audit_windows(stream.redact_stream(stamped, STRUCTURED_POLICY))
    return counts.select(F.unix_seconds("window_start").alias("window_start"), "category", "redactions")


def name_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.knowledge_base(_profiles(spark, sf_dir))


def name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_profiles(spark, sf_dir), POLICY.only(("NAME",)))
    return _listed(found.select("doc_id", "ordinal", F.explode("spans").alias("s")))


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_profiles(spark, sf_dir), POLICY)
    rows = found.select("doc_id", "ordinal", F.explode("spans").alias("s"))
    return rows.select("doc_id", "ordinal", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("value"), F.col("s.category").alias("category"))


def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy resolution of synthetic overlapping spans, a set per order."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    categories = F.array(*[F.lit(c) for c in S.RESOLVER_CATEGORIES])
    start = (F.col("l_partkey") % 40).cast("int")
    end = (start + 1 + F.col("l_suppkey") % 15).cast("int")
    category = F.element_at(categories, (F.col("l_partkey") % len(S.RESOLVER_CATEGORIES) + 1).cast("int"))
    span = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(start.alias("start"), end.alias("end"), F.lit("").alias("text"), category.alias("category"), F.lit("").alias("detector"), F.lit(1.0).alias("confidence")).alias("s"))
    sets = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))
    kept = sets.select("l_orderkey", F.explode(resolve(F.col("spans"))).alias("s"))
    return kept.select("l_orderkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.category").alias("category"))


def _structured(spark: SparkSession, sf_dir: str):
    return redact(_documents(spark, sf_dir), STRUCTURED_POLICY)


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span_rows(detect(_documents(spark, sf_dir), STRUCTURED_POLICY), STRUCTURED_POLICY)
    return spans.select("doc_id", "category", F.col("start").alias("span_start"), "entity_id")


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).spans.select("entity_id", "category", "replacement").distinct()


def pseudonyms_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_profiles(spark, sf_dir), POLICY).spans.select("doc_id", "ordinal", F.col("start").alias("span_start"), "category", "entity_id", "replacement")


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).texts().select("doc_id", "redacted_text")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).audit().select("doc_id", "unit_id", "category", "entity_id", "replacement", F.col("start").alias("span_start"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).summary()


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).leaks().agg(F.count(F.lit(1)).alias("leaks"))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions over documents, and gold made from them by deterministic drops, shifts and extras."""
    found = detect(_documents(spark, sf_dir), STRUCTURED_POLICY).select(F.col("doc_id").alias("unit_id"), F.explode("spans").alias("s"))
    spans = found.select("unit_id", "s.start", "s.end", "s.category")
    turn = (F.col("unit_id").cast("long") + F.col("start")) % 7
    truth = spans.where(turn != 0).withColumn("end", F.when(turn.isin(1, 2), F.col("end") + 2).otherwise(F.col("end")))
    extra = spans.where(turn == 3).select("unit_id", (F.col("end") + 5).alias("start"), (F.col("end") + 9).alias("end"), "category")
    return in_order(spans), in_order(truth.unionByName(extra))


def _scored(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate.metrics(*_judged(spark, sf_dir), mode)

    return query


def eval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes over one pass of detection, as the two-mode report has them."""
    preds, golds = _judged(spark, sf_dir)
    both = [evaluate.metrics(preds, golds, mode).withColumn("mode", F.lit(mode)) for mode in ("strict", "overlap")]
    return both[0].unionByName(both[1])


def eval_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores restricted to a scope: units whose number is divisible by three."""
    scope = _documents(spark, sf_dir).select(F.col("doc_id").alias("unit_id")).where(F.col("unit_id").cast("long") % 3 == 0)
    return evaluate.metrics(*_judged(spark, sf_dir), "overlap", scope=scope)


def char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _documents(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.length("text").alias("n"))
    return evaluate.character_accuracy(*_judged(spark, sf_dir), lengths)


def gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated substrings of customer texts; repeated ones take later occurrences, missing ones none."""
    customers = _table(spark, sf_dir, "customer")
    units = customers.select(F.col("c_custkey").cast("string").alias("unit_id"), F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" and "), "c_mktsegment", F.lit(" end")).alias("text"))
    items = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("NAME").alias("category"), F.col("c_name").alias("substring")), *[F.struct(F.lit(k).alias("ordinal"), F.lit("COMPANY").alias("category"), F.col("c_mktsegment").alias("substring")) for k in (1, 2, 3)])
    notes = customers.select(F.col("c_custkey").cast("string").alias("unit_id"), F.explode(items).alias("i")).select("unit_id", "i.*")
    spans, problems = gold.build_gold(notes, units)
    placed = spans.select("unit_id", "ordinal", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", F.lit(None).cast("string").alias("problem"))
    return placed.unionByName(problems.select("unit_id", "ordinal", F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"), F.lit(None).cast("string").alias("category"), F.col("reason").alias("problem")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.substring("c_name", 1, 5), F.lit(""), F.expr("substr(c_name, 6)"), F.lit(""), F.col("c_mktsegment"))
    return _table(spark, sf_dir, "customer").select("c_custkey", run_offsets(parts).alias("runs"))


def run_offset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("c_custkey", F.explode("runs").alias("r"))
    return rows.select("c_custkey", F.col("r.idx").alias("idx"), F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.text").alias("run_text"))


def run_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement that begins in one run and ends in a later one, across an empty run."""
    start = (F.col("c_custkey") % 5).cast("int")
    rep = F.array(F.struct(start.alias("start"), (start + 6).alias("end"), F.lit("<X>").alias("replacement")))
    rows = _runs(spark, sf_dir).withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    fresh = rows.select("c_custkey", F.explode(rewrite_runs(F.col("text"), F.col("runs"), rep)).alias("r"))
    return fresh.select("c_custkey", F.col("r.idx").alias("idx"), F.col("r.text").alias("run_text"))


def docx_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of DOCX files made from the supplier table, one file per nation, parsed again."""
    from textguard.sources import docx, workers
    from textguard.sources.docx_writer import build_batches

    rows = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list("s_name")).alias("texts"))
    workers.ship(spark)
    return docx.units_of(rows.mapInPandas(build_batches, "doc_id string, content binary")).drop("runs")


def _page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all structured categories in raw markup, overlaps resolved."""
    found = detect(text_units(_table(spark, sf_dir, "pages"), "page_id", "html"), STRUCTURED_POLICY)
    spans = found.select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.category").alias("category"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("value"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans counted by category, with the pages that have them."""
    return _page_spans(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("documents"))


QUERIES = {
    "email_spans": _document_spans("EMAIL"),
    "phone_spans": _document_spans("PHONE"),
    "card_spans": _document_spans("CREDIT_CARD"),
    "ip_spans": _document_spans("IP"),
    "ssn_spans": _profile_spans(STRUCTURED["SSN"]),
    "dob_spans": _profile_spans(STRUCTURED["DOB"]),
    "company_spans": _profile_spans(lambda c: entities.company(c, POLICY.company_allowlist)),
    "address_spans": _profile_spans(entities.address),
    "name_tables": name_tables,
    "registered_spans": registered_spans,
    "stream_windows": stream_windows,
    "name_kb": name_kb,
    "name_spans": name_spans,
    "profile_spans": resolved_spans,
    "resolved_spans": resolver,
    "entity_ids": entity_ids,
    "pseudonyms": pseudonyms,
    "pseudonyms_profiles": pseudonyms_profiles,
    "redacted_text": redacted_text,
    "audit_events": audit_events,
    "audit_summary": audit_summary,
    "leak_check": leak_check,
    "eval_strict": _scored("strict"),
    "eval_overlap": _scored("overlap"),
    "eval_modes": eval_modes,
    "eval_scope": eval_scope,
    "char_accuracy": char_accuracy,
    "gold_build": gold_build,
    "run_offsets": run_offset_rows,
    "run_rewrite": run_rewrite,
    "page_categories": _pages,
    "page_spans": _page_spans,
    "docx_units": docx_units,
}
ORACLES = S.oracles(POLICY)
