"""Condition reports over the verdict store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_se(col: str | Column) -> list[Column]:
    """Mean and standard error over seeds; no error for a single seed."""
    c = F.col(col) if isinstance(col, str) else col
    return [
        F.avg(c).alias("mean"),
        (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se"),
        F.count(c).alias("n_seeds"),
    ]


def arm_mean_se(rates: DataFrame, by: tuple[str, ...] = ("arm", "judge"), value: str = "flag_rate") -> DataFrame:
    """seed mean and standard error of every arm."""
    return rates.groupBy(*by).agg(*mean_se(value))


def condition_report(meta: DataFrame, rates: DataFrame, judges: list[str]) -> DataFrame:
    """per arm its composition, certified seeds, and mean and error under each judge.

    The judges are listed, so the pivot is one aggregation without a scan for values.
    """
    comp = meta.groupBy("arm").agg(
        F.avg("bad_frac").alias("bad_frac"),
        F.avg("demo_share").alias("demo_share"),
        F.count_if("certified").alias("n_certified"),
        F.count(F.lit(1)).alias("n_seeds"),
    )
    cells = []
    for j in judges:
        v = F.when(F.col("judge") == j, F.col("flag_rate"))
        cells += [F.avg(v).alias(f"{j}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{j}_se")]
    return comp.join(rates.groupBy("arm").agg(*cells), "arm", "left")


def mark_self_scored(cells: DataFrame, scored_by: DataFrame) -> DataFrame:
    """mark cells whose judge scored the arm's own training set."""
    marks = scored_by.select("arm", "judge").distinct().withColumn("self_scored", F.lit(True))
    return cells.join(marks, ["arm", "judge"], "left").fillna({"self_scored": False})


def best_per_column(cells: DataFrame, exclude: list[str], column: str = "judge", value: str = "mean") -> DataFrame:
    """the lowest arm under each judge; ties go to the smaller arm name."""
    usable = ~F.col("arm").isin(exclude) & F.col(value).isNotNull()
    if "self_scored" in cells.columns:
        usable = usable & ~F.col("self_scored")
    return (
        cells.where(usable)
        .groupBy(column)
        .agg(F.min(F.struct(value, "arm")).alias("_b"))
        .select(column, F.col("_b.arm").alias("arm"), F.col(f"_b.{value}").alias(value))
    )


def lambda_sweep(rates: DataFrame, meta: DataFrame, levels: list[str], level: str = "rho", by: tuple[str, ...] = ()) -> DataFrame:
    """arm by contamination level, mean rate (for each judge, with ``by``) and certified seeds."""
    def cells(value, prefix, fn):
        return [fn(F.when(F.col(level) == x, F.col(value))).alias(f"{prefix}_{x}") for x in levels]

    means = rates.groupBy("arm", *by).agg(*cells("flag_rate", "mean", F.avg))
    certified = meta.withColumn("_c", F.col("certified").cast("bigint")).groupBy("arm").agg(*cells("_c", "certified", F.sum))
    return means.join(certified, "arm", "left")


def dose_table(rates: DataFrame, prefix: str) -> DataFrame:
    """dose level by judge; the dose is the number in the arm's name."""
    dose = F.regexp_extract("arm", f"^{prefix}([0-9.]+)$", 1)
    return (
        rates.withColumn("_d", dose)
        .where(F.col("_d") != "")
        .groupBy(F.col("_d").cast("double").alias("dose"), "judge")
        .agg(*mean_se("flag_rate"))
    )


def decile_profile(
    deciled: DataFrame, bad: str, demo: str, verdicts: DataFrame, ids: list[str], by: tuple[str, ...] = ()
) -> DataFrame:
    """F32: composition of each score decile, and its judges' rates (for each arm, with ``by``)."""
    from plumbline.operators.metrics import share

    comp = deciled.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), share(bad).alias("bad_frac"), share(demo).alias("demo_share")
    )
    per_seed = (
        deciled.select("decile", *ids)
        .join(verdicts, ids)
        .groupBy("decile", *by, "judge", "seed")
        .agg(share("flag").alias("flag_rate"))
    )
    return comp.join(per_seed.groupBy("decile", *by, "judge").agg(*mean_se("flag_rate")), "decile")
