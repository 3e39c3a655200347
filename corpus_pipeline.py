"""The corpus pipeline: five operators in turn over ``documents``, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of ``docs``. Every stage works on all rows that its predecessor kept.

Defined results: a null, empty or letterless text goes in ``language_id``; a null id is a document like others, but
goes in ``near_dedup`` if its component has an id; of rows with one id each is judged by its own text; very
long texts are read whole; of ties the least id stays; equal rows stay or go together; a null in
any other column is passed on, and so are extra columns; an empty table gives an empty table; an empty
``benchmark`` drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textguard.llm import decontaminate, langid, minhash, packing, secrets
from textguard.llm.common import scratch_path, table
from textguard.sources.scratch import delete


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays: five-word shingles, likeness 0.8 or more."""
    return minhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; no document goes."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the space-filling curve."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Model-based stages have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and reread."""
    docs, path = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        before, path = path, scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)  # the next stage has read it
    return docs
