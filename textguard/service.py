"""Redaction of one uploaded file, and of folders of files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from textguard.operators import audit
from textguard.plans.redact import redact
from textguard.schema import Settings, load_settings
from textguard.sources import docx


def redact_bytes(spark: SparkSession, content: bytes, categories, use_ner: bool = False, settings: Settings | None = None) -> dict:
    """redacted_bytes, audit_bytes and summary of one DOCX; nothing is written to disk."""
    from dataclasses import replace

    policy = replace((settings or load_settings()).only(categories), use_ner=use_ner)
    files = spark.createDataFrame([("upload.docx", bytearray(content))], "doc_id string, content binary")
    run = redact(docx.units_of(files), policy)
    done = docx.rewritten_files(files, run.runs()).first()
    rows = run.audit().orderBy("ordinal", "start").collect()  # of one file
    lines = [json.dumps({k: r[k] for k in ("unit_id", "category", "entity_id", "replacement")}, ensure_ascii=False) + "\n" for r in rows]
    summary = audit.summary_dict(run.spans)
    run.close()
    return {"redacted_bytes": bytes(done["content"]), "audit_bytes": "".join(lines).encode(), "summary": summary}


def redact_folder(spark: SparkSession, source: str, target: str, audit_path: str | None = None, settings: Settings | None = None) -> dict:
    """All DOCX files of a folder; returns the summary."""
    files = docx.read_files(spark, source)
    run = redact(docx.units_of(files), settings or load_settings())
    docx.save_files(docx.rewritten_files(files, run.runs()), target, source)
    if audit_path:
        audit.write_jsonl(run.spans, audit_path)
    summary = audit.summary_dict(run.spans)
    run.close()
    return summary
