"""Command line.

python -m textguard.cli redact --input IN --output OUT [--audit LOG] [--config YAML]
python -m textguard.cli evaluate --input IN --gold GOLD [--scope SCOPE] [--report FILE] [--both-modes]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textguard.operators import evaluate
from textguard.plans.redact import redact
from textguard.schema import load_settings
from textguard.service import redact_folder
from textguard.sources import docx, gold


def report(spark: SparkSession, source: str, gold_path: str, settings, scope_path: str | None = None, modes: tuple[str, ...] = ()) -> str:
    """Scores of one redaction pass in one mode or several."""
    run = redact(docx.units_of(docx.read_files(spark, source)), settings)
    truth, scope = gold.read_gold(spark, gold_path), gold.read_scope(spark, scope_path) if scope_path else None
    units = run.units.withColumn("doc_id", docx.name_below(F.col("doc_id"), source))
    spans = run.spans.select(docx.name_below(F.col("doc_id"), source).alias("doc_id"), "unit_id", "start", "end", "category")
    if truth.where("doc_id is not null").isEmpty():
        if units.select("doc_id").distinct().limit(2).count() > 1:
            raise ValueError("gold of several files must name each span's file as doc_id")
        truth, units, spans = truth.drop("doc_id"), units.drop("doc_id"), spans.drop("doc_id")
    found = gold.in_order(spans).persist()
    live = units.where(F.col("text").rlike(r"(?U)\S")).select(*[c for c in ("doc_id", "unit_id") if c in units.columns], F.length("text").alias("n"))
    if scope is None or scope.isEmpty():
        keys = [c for c in ("doc_id", "unit_id") if c in found.columns]
        scope = found.select(*keys).union(truth.select(*keys)).distinct()
    accuracy = evaluate.character_accuracy(found, truth, live, scope).first()["accuracy"]
    out = [evaluate.render(evaluate.metrics(found, truth, m, settings.categories, scope), m, accuracy) for m in modes or (settings.match_mode,)]
    found.unpersist()
    run.close()
    return "\n\n".join(out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Redaction of personal data in DOCX files")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("redact")
    two = sub.add_parser("evaluate")
    for p in (one, two):
        p.add_argument("--input", required=True)
        p.add_argument("--config")
    one.add_argument("--output", required=True)
    one.add_argument("--audit")
    two.add_argument("--gold", required=True)
    two.add_argument("--scope")
    two.add_argument("--report")
    two.add_argument("--both-modes", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("textguard").getOrCreate()
    settings = load_settings(args.config)
    if args.command == "redact":
        print(json.dumps(redact_folder(spark, args.input, args.output, args.audit, settings), indent=2))
        return 0
    text = report(spark, args.input, args.gold, settings, args.scope, ("strict", "overlap") if args.both_modes else ())
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
