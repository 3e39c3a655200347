"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textguard.llm import decontaminate, langid, minhash, orc_tokens, packing, secrets, sharding, spotsigs, toxicity, urls
from textguard.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report_secrets(table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_store_index(table(spark, sf_dir, "documents"))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages")).drop("score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_spotsigs, op4_hash_tree, op5_language_id, op6_orc_tokens, op7_hilbert_packing, op8_decontamination, op9_url_filter, op10_minhash)}
ORACLES = {"op2_secrets": secrets.ORACLE, "op4_hash_tree": sharding.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op9_url_filter": urls.oracle(), "op10_minhash": minhash.ORACLE}
