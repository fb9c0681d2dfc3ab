"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import docpairs, grammar, mixing, personal, provenance, secrets, tokens
from lodestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.invalid_files(table(spark, sf_dir, "files"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.invalid_rates(table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.not_by_hand(table(spark, sf_dir, "files")).select("file_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.not_by_hand(table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = secrets.code_texts(table(spark, sf_dir, "files"), table(spark, sf_dir, "code_entities"))
    return secrets.find_secrets(texts).select("source_table", "record_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = secrets.code_texts(table(spark, sf_dir, "files"), table(spark, sf_dir, "code_entities"))
    return secrets.redact(secrets.first_deliveries(texts)).select("source_table", "record_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.function_pairs(table(spark, sf_dir, "code_entities"), table(spark, sf_dir, "files")).select("entity_id")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.function_pairs(table(spark, sf_dir, "code_entities"), table(spark, sf_dir, "files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = personal.find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "contributors"))
    return details.select("doc_id", "kind", "found").distinct()


def p9_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.replace_personal(docs, personal.find_personal(docs, table(spark, sf_dir, "contributors")))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p2_kinds": p2_kinds, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p5_pairs": p5_pairs, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_replaced": p9_replaced}
ORACLE: dict[str, str] = {}
