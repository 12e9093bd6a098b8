"""The pN queries of the problems tagged llm: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillscan.llm import byte_pairs, credentials, cut_text, leaks, not_handwritten, parsing, text_quality, top_items
from quillscan.session import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.top_findings(load(spark, sf_dir, "findings"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_text.cut_sections(load(spark, sf_dir, "llm_sections"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_text.cut_rates(load(spark, sf_dir, "llm_sections"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "findings"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "findings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten.not_handwritten(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "repo_catalog"))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten.judged(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "repo_catalog"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.unparsable(load(spark, sf_dir, "scan_files"))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.failure_rates(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "scans"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encode_ids(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.not_prose(load(spark, sf_dir, "documents"))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.classified(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("prose")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_reasons": p5_reasons, "p7_found": p7_found, "p7_rates": p7_rates, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_stats": p10_stats}
