"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES
from . import bpe, chat, decontaminate, katz, language_id, mil_quality, near_duplicates, pii, quality_rules, unit_dedup



def byte_bpe() -> tuple[str, str]:
    """Ranks and pattern of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.op1_katz(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op2_quality_rules(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op3_near_duplicates(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4_pii(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op5_chat(table(spark, sf_dir, "conversations"), *byte_bpe())


def piece_file() -> str:
    """The SentencePiece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6_language_id(table(spark, sf_dir, "documents"), piece_file())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.op7_unit_dedup(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op8_bpe(table(spark, sf_dir, "documents"), *byte_bpe())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.op9_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Queries of the base columns alone, which SQL can state; the queries of the operators add what their methods find.
BASES = {
    "base_katz": (op1, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 6) AS base_score"]),
    "base_quality_rules": (op2, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    "base_pii": (op4, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
}


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain rule of op7's operator: every later occurrence of a unit goes."""
    out = unit_dedup.deduplicated(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_units", "n_removed", spans.alias("removed"))


def _base(query: Callable[[SparkSession, str], DataFrame], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir).selectExpr(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_katz": op1, "op2_quality_rules": op2, "op3_near_duplicates": op3, "op4_pii": op4, "op5_chat": op5, "op6_language_id": op6, "op7_unit_dedup": op7, "op8_bpe": op8, "op9_quality_classifier": op9, "op10_decontamination": op10} | {name: _base(*b) for name, b in BASES.items()} | {"line_dedup": line_dedup}


def oracle_sql() -> dict[str, str]:
    return ORACLES
