"""Scorers as Spark jobs (C1-C4) and threshold tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame | pd.Series]


def score_with(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    inputs: list[str],
    out: str = "score double",
    batch: int = 16,
) -> DataFrame:
    """Score every row with a pluggable scorer.

    ``make_scorer`` runs once per task, where a model would be loaded; the
    scorer then sees ``batch`` rows at a time and returns the ``out`` columns.
    Only what is needed travels to Python: the columns of ``df`` and back.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), out])
    names = [c.strip().split()[0] for c in out.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for part in parts:
            done = []
            for at in range(0, len(part), batch):
                got = score(part.iloc[at : at + batch][inputs])
                done.append(got.to_frame(names[0]) if isinstance(got, pd.Series) else got[names])
            if done:
                res = pd.concat(done, ignore_index=True)
                yield pd.concat([part.reset_index(drop=True), res], axis=1)

    return df.mapInPandas(run, schema)


def orient(col: str | Column, how: str) -> Column:
    """Turn any score into higher = judged better."""
    c = F.col(col) if isinstance(col, str) else col
    return {"safe": c, "unsafe": -c, "probability": F.lit(1.0) - c}[how]


def flag(col: str | Column, rule: str) -> Column:
    """Log-odds below zero, probability above one half, or any category above one half."""
    c = F.col(col) if isinstance(col, str) else col
    if rule == "log_odds":
        return c < 0
    if rule == "probability":
        return c > 0.5
    return F.array_max(c) > 0.5


def score_missing(
    items: DataFrame, cache: DataFrame, keys: list[str], scorer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """C4: score only what the cache lacks; returns cache plus new rows.

    The cache is keyed by model and judge, a short list next to the items.
    """
    todo = items.join(cache.select(*keys).distinct(), keys, "left_anti")
    return cache.unionByName(scorer(todo).select(*cache.columns))


def tune_threshold(
    scored: DataFrame, bad: str, score: str, configs: list[str], steps: int = 100
) -> DataFrame:
    """The (config, threshold) with the best F1 on labelled validation rows.

    ``scored`` is long: one row per config and validation row. Thresholds are
    ``steps`` equal steps from the minimum, never the maximum; a row is flagged
    when its score is above. The first best wins in config, then step order. A
    row is counted once, at the number of thresholds below its score; sums from above give all steps.
    """
    span = scored.groupBy(*configs).agg(F.min(score).alias("_a"), F.max(score).alias("_z"))

    def tau(step: Column) -> Column:
        return F.col("_a") + (F.col("_z") - F.col("_a")) / steps * step

    # how many thresholds lie below a score: from the step's arithmetic, then made exact by its neighbours
    width = (F.col("_z") - F.col("_a")) / steps
    about = F.floor((F.col(score) - F.col("_a")) / F.when(width > 0, width)).cast("int")
    below = F.greatest(F.lit(0), F.coalesce(about, F.lit(0)) - 1)
    for _ in range(3):
        below = below + F.when((below < steps) & (tau(below) < F.col(score)), 1).otherwise(0)
    counts = scored.join(span, configs).groupBy(*configs, "_a", "_z", below.alias("step")).agg(
        F.count_if(F.col(bad)).alias("_bad"), F.count_if(~F.col(bad)).alias("_good")
    )
    # F1 changes only at steps where some score ends, so these are the candidates; at most steps + 1 rows a config
    every = Window.partitionBy(*configs)
    above = every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *configs, "step", tau(F.col("step")).alias("tau"), F.coalesce(F.sum("_bad").over(above), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("_good").over(above), F.lit(0)).alias("_fp"), F.sum("_bad").over(every).alias("_all"),
    )
    tp = F.col("_tp")
    f1 = F.when(tp > 0, 2 * tp / (tp + F.col("_fp") + F.col("_all"))).otherwise(F.lit(0.0))
    per_step = counts.where(F.col("step") < steps).withColumn("f1", f1)
    best = F.min(F.struct((-F.col("f1")).alias("_f"), *configs, "step", "tau")).alias("_b")
    return per_step.agg(best).select(
        *[F.col(f"_b.{c}").alias(c) for c in configs],
        F.col("_b.step").alias("step"),
        F.col("_b.tau").alias("tau"),
        (-F.col("_b._f")).alias("f1"),
    )
