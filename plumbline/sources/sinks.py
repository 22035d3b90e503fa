"""Sinks and stored tables (K1-K4)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the system prompt of the instruction export.
SYSTEM_PROMPT = "You are a helpful assistant."


def _write_by_run(df: DataFrame, path: str) -> None:
    (
        df.repartition("arm", "seed").write.partitionBy("arm", "seed")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_selection(selection: DataFrame, path: str, decisions: DataFrame | None = None) -> None:
    """K1: selections (arm, seed, ids...) as a table partitioned by arm and seed.

    Rewriting some (arm, seed) pairs leaves the others as they are. ``decisions``
    (arm, seed, and whatever a certificate says: certified, tau, n_sel, alpha, bound, one row per
    stratum) are kept beside the rows and come back by ``read_decisions``.
    """
    selection.write.partitionBy("arm", "seed").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if decisions is not None:
        _write_by_run(decisions, _decisions_path(path))


def _decisions_path(path: str) -> str:
    return path.rstrip("/") + ".decisions"


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """K1: the decisions stored with the selections at ``path``."""
    return spark.read.parquet(_decisions_path(path))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep_existing: bool = False) -> DataFrame:
    """K2: replace the rows whose key occurs in ``new``, or add only unseen keys."""
    if keep_existing:
        fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
        return existing.unionByName(fresh.select(*existing.columns))
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def instruction_rows(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """K3: the export's projection."""
    return df.select(
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        F.col(prompt).alias("question"),
        F.col(response).alias("response"),
    )


def export_instruction_jsonl(df: DataFrame, path: str) -> None:
    """K3: line-delimited JSON for an instruction trainer."""
    instruction_rows(df).write.json(path)


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(where)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """K4: reuse a finished table, or build and write it once.

    Only a table with its success marker counts, so a job that died half-way is
    built again. A table is written to a folder of its own and renamed, so that of two
    sessions that build the same one neither destroys what the other reads.
    """
    if not table_exists(spark, path):
        made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        build().write.parquet(made)
        own, fs = _place(spark, made)
        target, _ = _place(spark, path)
        if not table_exists(spark, path):
            fs.delete(target, True)  # what a dead job left
            fs.rename(own, target)
        else:
            fs.delete(own, True)
    return spark.read.parquet(path)
