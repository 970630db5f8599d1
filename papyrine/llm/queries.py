"""Queries of the llm operators, over the driver's tables. Production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import charform, packing, quality, repetition, scan_noise, tokenizer, truncation
from papyrine.operators import corpus
from papyrine.sources.tables import table


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transcripts_raw")


def p1_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charform.addresses(table(spark, sf_dir, "catalog"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charform.same_address_pairs(table(spark, sf_dir, "catalog"))


def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here and not in the core, because the cards' addresses are brought into one form first (problem 1)."""
    cards = charform.with_forms(table(spark, sf_dir, "catalog").dropna(subset=["opis_code", "delo"]), prefix="")
    return corpus.file_documents(_readings(spark, sf_dir), cards)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_readings(spark, sf_dir))


def p2_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(_readings(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeating(_readings(spark, sf_dir))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_readings(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noisy_lines(_readings(spark, sf_dir))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(_readings(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.with_ids(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack_documents(table(spark, sf_dir, "documents")))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.typed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_addresses, file_documents, p2_found, p2_by_source, p3_found, p3_shares, p5_found, p5_text, p6_ids, p7_containers, p7_fill, p8_found, p8_statistics)
    }


def oracle_sql() -> dict[str, str]:
    return {}
