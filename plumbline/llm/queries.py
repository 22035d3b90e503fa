"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    bpe, filter_audit, fingerprints, ngram_join, packing, pieces, quality, rules, secret_scans, sharding, spellings, suffixes, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _on_documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_table(spark, sf_dir, "documents"))


def _with_labels(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": _on_documents(packing.op1),
        "op2_quality": _with_labels(quality.op2),
        "op3_ngram_join": _on_documents(ngram_join.op3),
        "op4_suffix_dedup": _on_documents(suffixes.op4),
        "op5_fingerprints": _on_documents(fingerprints.op5),
        "op6_bpe": _on_documents(bpe.op6),
        "op7_sharding": _on_documents(sharding.op7),
        "op8_secrets": _on_documents(secret_scans.op8),
        "op9_quality_rules": _on_documents(rules.op9),
        "op10_toxicity": _with_labels(toxicity.op10),
        "op11_spellings": _on_documents(spellings.op11),
        "op12_pieces": _on_documents(pieces.op12),
        "op13_filter_audit": _with_labels(filter_audit.op13),
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against brute force in the tests."""
    return {"op3_ngram_join": ngram_join.OP3_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
