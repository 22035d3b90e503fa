"""Pool construction, labelling and profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import digest, variant_bit


def exclude_eval(df: DataFrame, evaluation: DataFrame, key: list[str]) -> DataFrame:
    """Drop rows whose key occurs in the evaluation set."""
    held = evaluation.select(digest(*key).alias("_key")).distinct()
    return df.withColumn("_key", digest(*key)).join(held, "_key", "left_anti").drop("_key")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in source order.

    An aggregate rather than a window: copies collapse before the shuffle, so a
    key that holds a third of the table stays cheap. Rows with a NULL key are
    one group, as in GROUP BY.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")
    kinds = dict(df.dtypes)
    short = [
        (F.coalesce(digest(k), F.lit("")) if kinds[k] == "string" else F.col(k)).alias(f"_k{i}")
        for i, k in enumerate(key)
    ]
    return df.groupBy(*short).agg(first).select("_first.*")


def dedup_exclude(
    df: DataFrame, key: list[str], order: list[str], exclude: DataFrame | None = None
) -> DataFrame:
    """Keep-first deduplication, then the evaluation keys are dropped."""
    first = keep_first(df, key, order)
    return exclude_eval(first, exclude, key) if exclude is not None else first


def pick_variant(
    df: DataFrame,
    prompt: str = "prompt",
    responses: tuple[str, str] = ("response_0", "response_1"),
    flags: tuple[str, str] = ("is_response_0_safe", "is_response_1_safe"),
) -> DataFrame:
    """P5: one of two responses by the parity of md5(prompt); flags may be strings."""
    second = variant_bit(prompt) == 1
    return df.select(
        prompt,
        F.when(second, F.col(responses[1])).otherwise(F.col(responses[0])).alias("response"),
        F.when(second, F.col(flags[1]).cast("boolean"))
        .otherwise(F.col(flags[0]).cast("boolean"))
        .alias("is_safe"),
    )


def label_by_membership(df: DataFrame, keep: DataFrame, keys: list[str], label: str = "is_safe") -> DataFrame:
    """A row is good when its key occurs in the kept subset."""
    marks = keep.select(digest(*keys).alias("_key")).distinct().withColumn("_kept", F.lit(True))
    return (
        df.withColumn("_key", digest(*keys))
        .join(marks, "_key", "left")
        .withColumn(label, F.col("_kept").isNotNull())
        .drop("_kept", "_key")
    )


def instruction_prompt(instruction: str, extra: str) -> Column:
    """Instruction plus its optional input."""
    return F.when(F.col(extra) != "", F.concat(F.col(instruction), F.lit("\n\n"), F.col(extra))).otherwise(
        F.col(instruction)
    )


def split_profile(df: DataFrame, split: str, bad: str) -> DataFrame:
    """Size and bad fraction of each split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(bad).cast("double")).alias("harmful_frac")
    )


def dataset_facts(
    rows: DataFrame, keep: DataFrame, keys: list[str], refs: DataFrame, evaluation: DataFrame, prompt: str
) -> DataFrame:
    """One row of counts: pool size, kept keys, low-quality share, reference and overlap counts."""
    labelled = label_by_membership(rows, keep, keys, "_good")
    sizes = labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((~F.col("_good")).cast("double")).alias("low_frac"),
    )
    kept = keep.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_kept"))
    prompts = lambda df: df.where(F.col(prompt).isNotNull()).select(digest(prompt).alias("_key"))
    with_ref = prompts(evaluation).join(prompts(refs).distinct(), "_key", "left_semi").agg(
        F.count(F.lit(1)).alias("with_reference")
    )
    shared = (
        prompts(rows)
        .distinct()
        .join(prompts(evaluation).distinct(), "_key", "left_semi")
        .agg(F.count(F.lit(1)).alias("shared_prompts"))
    )
    one = F.lit(0).alias("_one")
    out = sizes.select("*", one)
    for part in (kept, with_ref, shared):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def group_label(bad: str, req: str, refusal: str | None = None) -> Column:
    """Bad / benign / demo, the demo split by refusal where a refusal flag exists."""
    demo = F.lit("demo")
    if refusal:
        demo = F.when(F.col(refusal), F.lit("demo_refused")).otherwise(F.lit("demo_engaged"))
    return F.when(F.col(bad), F.lit("unsafe")).when(~F.col(req), F.lit("benign")).otherwise(demo)


def assign_groups(df: DataFrame, bad: str, req: str, refusal: str | None = None) -> DataFrame:
    return df.withColumn("group", group_label(bad, req, refusal))
