"""Selection rules (E1-E15). Each returns the kept rows of the pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw_key, tie_key
from plumbline.operators.metrics import share, share_where
from plumbline.operators.ranking import (
    cuts_of,
    first_ranks,
    key_cuts,
    lowest,
    mark_through,
    rank_cuts,
    rank_slots,
    value_cuts,
)
from plumbline.operators.sampling import calibration_draw, half_even, sample_exact, sample_per_stratum
from plumbline.session import pin

ORDER = "_order"


def _ranked(df: DataFrame, order: Column) -> DataFrame:
    return df.withColumn(ORDER, order.cast("double"))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(ORDER)


def select_all(df: DataFrame) -> DataFrame:
    """The whole pool."""
    return df


def select_oracle(df: DataFrame, bad: str) -> DataFrame:
    """Every good row."""
    return df.where(~F.col(bad))


def select_top(df: DataFrame, score: str, ids: list[str], k: int | None = None, frac: float | None = None) -> DataFrame:
    """The ``k`` best rows, or the best int(frac * N), by score."""
    rows = _ranked(df, -F.col(score))
    if k is not None:
        return _plain(lowest(rows, ORDER, tie_key(*ids), k))
    quota = cuts_of((0, f"CAST({float(frac)!r}D * n_total AS BIGINT)"))
    return _plain(first_ranks(rows, ORDER, tie_key(*ids), quota))


def select_bottom(df: DataFrame, score: str, ids: list[str], k: int) -> DataFrame:
    """The ``k`` worst rows, a filter's rejects."""
    return _plain(lowest(_ranked(df, F.col(score)), ORDER, tie_key(*ids), k))


def select_cutoff(df: DataFrame, score: str, cut: float = 0.0) -> DataFrame:
    """A fixed cutoff on a higher-is-worse score, no labels."""
    return df.where(F.col(score) <= cut)


def select_unflagged(df: DataFrame, flag: str) -> DataFrame:
    """Everything a detector does not flag."""
    return df.where(~F.col(flag))


def select_labelled_safe(df: DataFrame, bad: str, n: int, seed: int, ids: list[str]) -> DataFrame:
    """E5: the good rows among the calibration labels."""
    return calibration_draw(df, n, seed, ids).where(~F.col(bad))


def _matched(df: DataFrame, size_of: DataFrame, seed: int, ids: list[str], tag: str) -> DataFrame:
    size = pin(size_of.agg(F.lit(0).alias("cut"), F.count(F.lit(1)).alias("rank")))
    key = draw_key(tag, seed, *ids)
    return first_ranks(df, None, key, size)


def select_random_matched(df: DataFrame, reference: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """A uniform draw at another arm's size."""
    return _matched(df, reference, seed, ids, "random")


def select_oracle_matched(df: DataFrame, bad: str, reference: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """A uniform draw of good rows at another arm's size."""
    return _matched(select_oracle(df, bad), reference, seed, ids, "oracle")


def with_decile(df: DataFrame, score: str, ids: list[str], parts: int = 10) -> DataFrame:
    """Add ``decile``, equal blocks by score, 0 = best; earlier blocks take the remainder."""

    rows = _ranked(df, -F.col(score))
    ends = [(i, f"{i} * (n_total div {parts}) + least({i}, n_total % {parts})") for i in range(1, parts)]
    bounds = rank_cuts(rows, ORDER, tie_key(*ids), cuts_of(*ends))
    slotted = rank_slots(rows, bounds, ORDER, tie_key(*ids), list(range(1, parts)))
    return _plain(slotted.withColumnRenamed("slot", "decile"))


def select_decile(df: DataFrame, score: str, ids: list[str], decile: int) -> DataFrame:
    return with_decile(df, score, ids).where(F.col("decile") == decile).drop("decile")


def select_dose(
    df: DataFrame, subgroup: str, bad: str, dose: float, n: int, n_bad: int, seed: int, ids: list[str]
) -> DataFrame:
    """Fixed size and bad count; ``dose`` of the good rows come from the subgroup."""
    n_good = n - n_bad
    n_sub = round(dose * n_good)
    part = F.when(F.col(bad), F.lit("bad")).when(F.col(subgroup), F.lit("sub")).otherwise(F.lit("rest"))
    quotas = df.sparkSession.createDataFrame(
        [("bad", n_bad), ("sub", n_sub), ("rest", n_good - n_sub)], "_part string, quota bigint"
    )
    return sample_per_stratum(df.withColumn("_part", part), ["_part"], quotas, seed, ids, f"dose{dose}").drop("_part")


def with_rank_band(df: DataFrame, score: str, ids: list[str], bands: int = 3) -> DataFrame:
    """Add ``band`` by score rank, best first; the last band takes the remainder."""
    rows = _ranked(df, -F.col(score))
    ends = cuts_of(*[(i, f"{i} * (n_total div {bands})") for i in range(1, bands)])
    bounds = rank_cuts(rows, ORDER, tie_key(*ids), ends)
    slotted = rank_slots(rows, bounds, ORDER, tie_key(*ids), list(range(1, bands)))
    return _plain(slotted.withColumnRenamed("slot", "band"))


def select_rank_band(
    df: DataFrame, score: str, bad: str, band: int, n: int, seed: int, ids: list[str], bands: int = 3
) -> DataFrame:
    """``n`` bad rows drawn from one rank band of the bad rows."""
    banded = with_rank_band(df.where(F.col(bad)), score, ids, bands).where(F.col("band") == band).drop("band")
    return sample_exact(banded, n, seed, ids, tag=f"band{band}")


def select_top_per_stratum(
    df: DataFrame, score: str, strata: list[str], ks: DataFrame, ids: list[str]
) -> DataFrame:
    """The best ``k`` rows of every stratum; ``ks`` is (strata, k)."""
    quotas = ks.select(*strata, F.lit(0).alias("cut"), F.col("k").cast("bigint").alias("rank"))
    return _plain(first_ranks(_ranked(df, -F.col(score)), ORDER, tie_key(*ids), quotas, strata))


def decile_edges(lengths: DataFrame, col: str, parts: int = 10) -> list[float]:
    """The inner quantile edges of a length column, linearly interpolated."""

    cuts = []
    for d in range(1, parts):
        below = f"((n_total - 1) * {d}) div {parts}"
        cuts += [(2 * d, f"{below} + 1"), (2 * d + 1, f"least(n_total, {below} + 2)")]
    rows = value_cuts(lengths.select(F.col(col).cast("double").alias(col)), col, cuts_of(*cuts))
    at = {r["cut"]: (r["value"], r["n_total"]) for r in rows.collect()}
    edges = []
    for d in range(1, parts):
        lo, n = at[2 * d]
        edges.append(lo + (at[2 * d + 1][0] - lo) * (((n - 1) * d % parts) / parts))
    return edges


def length_quotas(
    reference: DataFrame, length: str, stratum: str, wants: dict[str, int], edges: list[float]
) -> DataFrame:
    """Rows wanted per (stratum, bin), proportional to the reference lengths.

    Reference bins are closed on the left; the last bin absorbs the rounding.
    """
    points = F.array(*[F.lit(e) for e in edges])
    last = len(edges)
    counted = reference.groupBy(
        F.size(F.filter(points, lambda e: e <= F.col(length))).alias("bin")
    ).agg(F.count(F.lit(1)).alias("_c"))
    bins = reference.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    shares = bins.join(counted, "bin", "left").select("bin", F.coalesce("_c", F.lit(0)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())
    shares = shares.select("bin", (F.col("_c") / total).alias("_share"))
    rows = F.array(*[F.struct(F.lit(s).alias(stratum), F.lit(int(w)).alias("_want")) for s, w in wants.items()])
    rounded = shares.select("bin", "_share", F.inline(rows)).withColumn("_q", half_even(F.col("_share") * F.col("_want")))
    others = F.sum(F.when(F.col("bin") < last, F.col("_q"))).over(Window.partitionBy(stratum))
    quota = F.when(F.col("bin") < last, F.col("_q")).otherwise(F.col("_want") - others)
    return pin(rounded.select(stratum, "bin", F.greatest(quota, F.lit(0).cast("bigint")).alias("quota")))


def select_length_matched(
    df: DataFrame,
    reference: DataFrame,
    length: str,
    stratum: str,
    wants: dict[str, int],
    seed: int,
    ids: list[str],
) -> DataFrame:
    """Score-blind rows of each stratum whose lengths follow the reference arm.

    ``df`` holds the candidates with their ``stratum``. Candidate bins are
    closed on the right. What a bin cannot supply is topped up from the
    candidates left over, whatever their stratum.
    """
    edges = decile_edges(reference, length)
    quotas = length_quotas(reference, length, stratum, wants, edges)
    points = F.array(*[F.lit(e) for e in edges])
    rows = (
        df.where(F.col(stratum).isin(list(wants)))
        .withColumn("bin", F.size(F.filter(points, lambda e: e < F.col(length))))
    )
    key = draw_key("length", seed, *ids)
    cuts = quotas.select(stratum, "bin", F.lit(0).alias("cut"), F.col("quota").alias("rank"))
    bounds = key_cuts(rows, key, cuts, [stratum, "bin"])
    marked = mark_through(rows, bounds, None, key, [stratum, "bin"])
    short = pin(
        marked.agg(F.lit(0).alias("cut"), (F.lit(sum(wants.values())) - F.count_if("within")).alias("rank"))
    )
    picked = marked.where("within")
    if short.first()["rank"] > 0:
        left = marked.where("not within")
        picked = picked.unionByName(first_ranks(left, None, draw_key("topup", seed, *ids), short))
    return picked.drop("bin", "within")


def select_union(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """An arm augmented with further rows, each id once."""
    return a.select(*ids).union(b.select(*ids)).distinct()


def selection_meta(selection: DataFrame, pool: DataFrame, ids: list[str], bad: str, demo: str, score: str, length: str) -> DataFrame:
    """Composition of every stored selection."""
    joined = selection.select("arm", "seed", *ids).join(pool, ids)
    return joined.groupBy("arm", "seed").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(bad)).alias("n_bad"),
        share(bad).alias("bad_frac"),
        share(demo).alias("demo_share"),
        F.avg(F.when(~F.col(bad), F.col(score))).alias("good_score_mean"),
        F.avg(F.when(F.col(bad), F.col(score))).alias("bad_score_mean"),
        F.avg(F.when(~F.col(bad), F.col(length).cast("double"))).alias("good_len_mean"),
    )


def select_spectral(df: DataFrame, score: str, tau: float) -> DataFrame:
    """Keep rows at or below the tuned threshold of a higher-is-worse score."""
    return df.where(F.col(score) <= tau)


def spectral_flags(df: DataFrame, score: str, bad: str, tau: float | Column) -> DataFrame:
    """What the threshold flags overall, among bad and among good rows."""
    flagged = F.col(score) > tau
    return df.agg(
        F.count_if(~flagged).alias("n_kept"),
        share(flagged).alias("flagged_frac"),
        share_where(flagged, F.col(bad)).alias("recall_bad"),
        share_where(flagged, ~F.col(bad)).alias("rate_good"),
    )
