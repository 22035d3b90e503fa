"""Exact-size deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw_key
from plumbline.operators.ranking import first_ranks, lowest, with_position


def half_even(x: Column) -> Column:
    """Round to the even neighbour, as Python does."""
    return F.rint(x).cast("bigint")


def sample_exact(df: DataFrame, n: int, seed: int, ids: list[str], tag: str = "pool") -> DataFrame:
    """A uniform draw of exactly ``n`` rows without replacement."""
    return lowest(df, None, draw_key(tag, seed, *ids), n)


def calibration_draw(df: DataFrame, n: int, seed: int, ids: list[str]) -> DataFrame:
    """The rows whose labels are bought; every arm of a seed shares the draw."""
    return sample_exact(df, n, seed, ids, tag="cal")


def sample_per_stratum(
    df: DataFrame, strata: list[str], quotas: DataFrame, seed: int, ids: list[str], tag: str = "strata",
    allow_short: bool = False,
) -> DataFrame:
    """Exactly ``quota`` rows of every stratum; ``quotas`` is (strata, quota).

    Raises ValueError where a stratum has fewer rows than its quota (``shortfalls`` lists them);
    with ``allow_short`` such a stratum gives all its rows.
    """
    short = [] if allow_short else shortfalls(df, strata, quotas)
    if short:
        raise ValueError(f"too few rows: {short}")
    cuts = quotas.select(*strata, F.lit(0).alias("cut"), F.col("quota").cast("bigint").alias("rank"))
    return first_ranks(df, None, draw_key(tag, seed, *ids), cuts, strata)


def shortfalls(df: DataFrame, strata: list[str], quotas: DataFrame) -> list[dict]:
    """Strata with fewer rows than their quota, as dicts of the strata, ``quota`` and ``n``."""
    have = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    found = quotas.join(have, strata, "left").fillna({"n": 0}).where("quota > n")
    return [r.asDict() for r in found.collect()]  # at most one row per quota


def build_pool(
    df: DataFrame, n: int, bad_frac: float, seed: int, bad: str, ids: list[str], tag: str = "pool"
) -> DataFrame:
    """A contamination-controlled pool, round(bad_frac * n) bad rows and the rest good.

    ``position``, 0-based in the order of the draw's key, is the place in the shuffled list.
    """
    n_bad = round(bad_frac * n)
    quotas = df.sparkSession.createDataFrame([(True, n_bad), (False, n - n_bad)], f"{bad} boolean, quota bigint")
    drawn = sample_per_stratum(df, [bad], quotas, seed, ids, tag)
    return with_position(drawn, draw_key(tag, seed, *ids), "position")


def eval_prompts(df: DataFrame, prompt: str, n: int, seed: int) -> DataFrame:
    """``n`` of the distinct prompts."""
    return sample_exact(df.select(prompt).distinct(), n, seed, [prompt], tag="eval")


def preference_pairs(
    df: DataFrame, prompt: str, response: str, bad: str, pos: str, n: int, seed: int
) -> DataFrame:
    """Prompts with both classes, each side's first response, at most ``n`` of them."""
    good_first = F.min_by(response, F.when(~F.col(bad), F.col(pos))).alias("safe")
    bad_first = F.min_by(response, F.when(F.col(bad), F.col(pos))).alias("unsafe")
    both = (
        df.groupBy(prompt)
        .agg(good_first, bad_first, F.count_if(F.col(bad)).alias("_b"), F.count_if(~F.col(bad)).alias("_g"))
        .where("_b > 0 and _g > 0")
        .drop("_b", "_g")
    )
    return sample_exact(both, n, seed, [prompt], tag="pairs")
