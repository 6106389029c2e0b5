"""The corpus queries: op<N>_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import chat, fingerprints, licenses, minhash, mixing, periodic, pieces, quality_model, quality_rules, repair, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op3_licenses: notices anywhere in the words of a text."""
    return licenses.license_windows(_table(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_table(spark, sf_dir, "documents"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_mixing, op3_licenses, license_windows, op4_quality_model, op5_suffix_dedup, op6_warc, op7_pieces, op8_toxicity, op9_minhash, op10_quality_rules, op11_conversation_repair, op12_periodic_runs, op13_chat_windows]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.oracle_sql(),
        "op3_licenses": licenses.oracle_sql(),
        "op6_warc": warc.oracle_sql(),
        "op9_minhash": minhash.oracle_sql(),
        "op10_quality_rules": quality_rules.oracle_sql(),
        "op11_conversation_repair": repair.oracle_sql(),
        "op12_periodic_runs": periodic.oracle_sql(),
        "op13_chat_windows": chat.oracle_sql(),
    }
