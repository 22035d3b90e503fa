"""The certificate: the most permissive score cutoff whose kept rows are provably clean.

Everything is grouped by ``strata`` from the start; no strata means one pool.
``score`` is oriented so that higher means judged better. The pool side needs
scores only; labels are read from the calibration rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import tie_key
from plumbline.functions.stats import clopper_pearson_lower, p_lower, p_upper
from plumbline.operators.ranking import (
    ONE,
    attach,
    cuts_of,
    drop_one,
    keep_through,
    rank_cuts,
    value_cuts,
    with_strata,
)
from plumbline.operators.sampling import half_even
from plumbline.session import pin

# The score quantiles tested, most selective first, in hundredths.
GRID = (85, 80, 75, 70, 65, 60, 55, 50, 45, 40, 35, 30)


def _number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def grid_thresholds(
    df: DataFrame, score: str, strata: list[str] | None = None, grid: tuple[int, ...] = GRID
) -> DataFrame:
    """(strata, q100, n_pool, tau, n_sel) for every grid point.

    ``score >= tau`` keeps the same rows as a cut at the interpolated quantile,
    because the smallest kept value is an order statistic: position
    ceil((n-1) q), computed in integers. Ties at the cut are kept.
    """
    strata = strata or []
    rows, keys = with_strata(df.select(*strata, score), strata)
    at = value_cuts(rows, score, cuts_of(*[(q, f"((n_total - 1) * {q} + 99) div 100 + 1") for q in grid]), keys)
    out = at.select(
        *keys,
        F.col("cut").alias("q100"),
        F.col("n_total").alias("n_pool"),
        F.col("value").alias("tau"),
        (F.col("n_total") - F.col("below")).alias("n_sel"),
    )
    return out if strata else drop_one(out)


def kept_counts(
    df: DataFrame,
    score: str,
    cuts: DataFrame,
    measures: dict[str, Column],
    strata: list[str] | None = None,
    grid: tuple[int, ...] = GRID,
) -> DataFrame:
    """Sums of ``measures`` over the rows each cutoff in ``cuts`` (strata, q100, tau) keeps.

    One pass: a row only records how many cutoffs it passes (the kept sets are
    nested), so the shuffle carries grid+1 rows per stratum and task.
    """
    strata = strata or []
    rows, keys = with_strata(df, strata)
    cuts = cuts if strata else cuts.withColumn(ONE, F.lit(0))
    tau = {q: f"_tau{q}" for q in grid}
    wide = pin(
        cuts.groupBy(*keys).agg(*[F.max(F.when(F.col("q100") == q, F.col("tau"))).alias(c) for q, c in tau.items()])
    )
    passed = F.lit(0)
    for c in tau.values():
        passed = passed + F.when(F.col(score) >= F.col(c), 1).otherwise(0)
    names = list(measures)
    bins = (
        attach(rows, wide, keys)
        .select(*keys, passed.alias("_passed"), *[measures[m].alias(m) for m in names])
        .groupBy(*keys, "_passed")
        .agg(*[F.sum(m).alias(m) for m in names])
    )
    depth = F.row_number().over(Window.partitionBy(*keys).orderBy("q100"))
    out = (
        cuts.withColumn("_depth", depth)
        .join(bins, keys)
        .groupBy(*keys, "q100")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("_passed") >= F.col("_depth"), F.col(m))), F.lit(0)).alias(m)
                for m in names
            ]
        )
    )
    return out if strata else drop_one(out)


def _flag(c: str) -> Column:
    return F.col(c).cast("bigint")


def composition_curve(
    df: DataFrame,
    score: str,
    bad: str,
    strata: list[str] | None = None,
    grid: tuple[int, ...] = GRID,
) -> DataFrame:
    """Size, bad rows and bad fraction of every kept set."""
    strata = strata or []
    taus = grid_thresholds(df, score, strata, grid)
    bads = kept_counts(df, score, taus, {"k_sel": _flag(bad)}, strata, grid)
    return taus.join(bads, [*strata, "q100"]).withColumn("bad_frac", F.col("k_sel") / F.col("n_sel"))


def walk(audit: DataFrame, ok: Column, strata: list[str]) -> DataFrame:
    """Fixed-sequence walk from the most selective cutoff; stops at the first failure.

    Adds ``tested`` (up to and including the first failure), ``passed`` (before
    it) and ``deployed`` (the deepest passing cutoff).
    """
    audit, keys = with_strata(audit, strata)
    down = Window.partitionBy(*keys).orderBy(F.desc("q100"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        audit.withColumn("_ok", ok)
        .withColumn("passed", F.min("_ok").over(upto))
        .withColumn("tested", F.coalesce(F.min("_ok").over(before), F.lit(True)))
        .withColumn("deployed", F.col("passed") & ~F.coalesce(F.lead("passed").over(down), F.lit(False)))
        .drop("_ok")
    )
    return out if strata else drop_one(out)


def audit_counts(
    pool: DataFrame, cal: DataFrame, score: str, measures: dict[str, Column], strata: list[str], grid: tuple[int, ...]
) -> DataFrame:
    taus = grid_thresholds(pool, score, strata, grid)
    labels = kept_counts(cal, score, taus, {"m": F.lit(1).cast("bigint"), **measures}, strata, grid)
    filled = {c: 0 for c in ("m", *measures)}
    return taus.join(labels, [*strata, "q100"], "left").fillna(filled)


def certify(
    pool: DataFrame,
    cal: DataFrame,
    score: str,
    bad: str,
    alpha: float | Column,
    delta: float,
    strata: list[str] | None = None,
    grid: tuple[int, ...] = GRID,
) -> DataFrame:
    """The audit of the walk, one row per (strata, grid point).

    ``alpha`` may be a column over the strata. The pool is scanned for its
    scores; ``cal`` is the small labelled draw.
    """
    strata = strata or []
    counts = audit_counts(pool, cal, score, {"k": _flag(bad)}, strata, grid)
    return _tested(counts, alpha, delta, strata)


def _tested(counts: DataFrame, alpha: float | Column, delta: float, strata: list[str]) -> DataFrame:
    audit = pin(counts.withColumn("_a", _number(alpha)).withColumn("p", p_upper("k", "m", "n_sel", "_a")).drop("_a"))
    return walk(audit, F.col("p") <= delta, strata)


def certify_draws(
    pool: DataFrame,
    cal: DataFrame,
    draw: str,
    draws: list,
    score: str,
    bad: str,
    alpha: float | Column,
    delta: float,
    strata: list[str] | None = None,
    grid: tuple[int, ...] = GRID,
) -> DataFrame:
    """D4 for several calibration draws of one pool: one row per (draw, strata, grid point).

    ``cal`` holds the rows of all draws, told apart by its column ``draw``; ``draws`` lists
    the values wanted, so a draw without rows is refused rather than absent. The cutoffs
    depend on the pool alone and are found once, whatever the number of draws.
    """
    keys = [draw, *(strata or [])]
    taus = pin(grid_thresholds(pool, score, strata, grid)).withColumn(draw, F.explode(F.array(*[F.lit(d) for d in draws])))
    labels = kept_counts(cal, score, taus, {"m": F.lit(1).cast("bigint"), "k": _flag(bad)}, keys, grid)
    counts = taus.join(labels, [*keys, "q100"], "left").fillna({"m": 0, "k": 0})
    return _tested(counts, alpha, delta, keys)


def certify_first(
    pool: DataFrame, cal: DataFrame, score: str, bad: str, alpha: float | Column, delta: float,
    strata: list[str] | None = None,
) -> DataFrame:
    """The gate, which tests the most selective cutoff only."""
    return certify(pool, cal, score, bad, alpha, delta, strata, GRID[:1])


def certify_two(
    pool: DataFrame,
    cal: DataFrame,
    score: str,
    bad: str,
    wanted: str,
    alpha: float,
    beta: float | Column,
    delta: float,
    strata: list[str] | None = None,
    grid: tuple[int, ...] = GRID,
) -> DataFrame:
    """At most ``alpha`` bad and at least ``beta`` wanted, half of delta each."""
    strata = strata or []
    counts = audit_counts(pool, cal, score, {"k": _flag(bad), "k_wanted": _flag(wanted)}, strata, grid)
    audit = pin(
        counts.withColumns({"_a": _number(alpha), "_b": _number(beta)})
        .withColumn("p_bad", p_upper("k", "m", "n_sel", "_a"))
        .withColumn("p_wanted", p_lower("k_wanted", "m", "n_sel", "_b"))
        .drop("_a", "_b")
    )
    return walk(audit, F.greatest("p_bad", "p_wanted") <= delta / 2, strata)


def cutoffs(audit: DataFrame, strata: list[str] | None = None) -> DataFrame:
    """One row per stratum: certified, q100, tau and n_sel of the deployed cutoff (NULL when refused)."""
    rows, keys = with_strata(audit, strata or [])
    pick = [F.max(F.when(F.col("deployed"), F.col(c))).alias(c) for c in ("q100", "tau", "n_sel")]
    out = rows.groupBy(*keys).agg(
        F.max("deployed").alias("certified"), F.first("n_pool").alias("n_pool"), *pick
    )
    return out if strata else drop_one(out)


def fallback_sizes(
    pool_sizes: DataFrame, cal: DataFrame, bad: str, delta: float, strata: list[str] | None = None
) -> DataFrame:
    """Per stratum the lower bound on the good share and how many rows it keeps."""
    rows, keys = with_strata(cal, strata or [])
    sizes = pool_sizes if strata else pool_sizes.withColumn(ONE, F.lit(0))
    labels = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cal"), F.count_if(~F.col(bad)).alias("n_good")
    )
    bound = clopper_pearson_lower("n_good", "n_cal", delta)
    out = (
        sizes.join(labels, keys, "left")
        .fillna({"n_cal": 0, "n_good": 0})
        .withColumn("lower_bound", bound)
        .withColumn("keep", F.greatest(F.lit(1).cast("bigint"), half_even(F.col("lower_bound") * F.col("n_pool"))))
    )
    return out if strata else drop_one(out)


def cp_fallback(
    pool: DataFrame,
    cal: DataFrame,
    score: str,
    bad: str,
    delta: float,
    ids: list[str],
    strata: list[str] | None = None,
) -> DataFrame:
    """The uncertified fallback, the top ``keep`` rows by score in each stratum."""
    strata = strata or []
    rows, keys = with_strata(pool, strata)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pool"))
    cal_rows, _ = with_strata(cal, strata)
    sized = pin(fallback_sizes(sizes, cal_rows, bad, delta, keys))
    return drop_one(_top_of(rows, score, sized, ids, keys))


def _top_of(rows: DataFrame, score: str, sized: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    ordered = rows.withColumn("_order", -F.col(score))
    cuts = sized.select(*keys, F.lit(0).alias("cut"), F.col("keep").alias("rank"))
    bounds = rank_cuts(ordered, "_order", tie_key(*ids), cuts, keys)
    return keep_through(ordered, bounds, "_order", tie_key(*ids), keys).drop("_order")


def certified_selection(
    pool: DataFrame,
    cal: DataFrame,
    score: str,
    bad: str,
    alpha: float | Column,
    delta: float,
    ids: list[str],
    strata: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Certify each stratum or fall back inside it; returns (selection, decisions).

    With strata the caller's ``delta`` is split evenly over those of the pool, so
    the chance that any of them is wrong stays within ``delta``; a row without a
    stratum is an error, as it would get no decision. The selection is the union over strata and carries ``certified`` and
    ``alpha``; ``decisions`` has one row per stratum.
    """
    strata = strata or []
    rows, keys = with_strata(pool, strata)
    cal_rows, _ = with_strata(cal, strata)
    missing = F.max(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    found = rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"), missing.alias("missing")).first()
    if found.missing:
        raise ValueError(f"rows without a stratum in {strata}: give them one, or leave them out")
    each = delta / max(1, found.n)
    audit = certify(rows, cal_rows, score, bad, alpha, each, keys)
    decided = cutoffs(audit, keys)
    sizes = fallback_sizes(decided.select(*keys, "n_pool"), cal_rows, bad, each, keys).drop("n_pool")
    decisions = pin(decided.join(sizes, keys).withColumn("alpha", _number(alpha)))

    passed = decisions.where("certified").select(*keys, "tau")
    chosen = (
        attach(rows, passed, keys)
        .where(F.col(score) >= F.col("tau"))
        .drop("tau")
        .withColumn("certified", F.lit(True))
    )
    refused = decisions.where("not certified").select(*keys, "keep")
    if not refused.isEmpty():
        inside = rows.join(refused.select(*keys), keys, "left_semi") if strata else rows
        fallback = _top_of(inside, score, refused, ids, keys)
        chosen = chosen.unionByName(fallback.withColumn("certified", F.lit(False)))
    chosen = chosen.withColumn("alpha", _number(alpha))
    return (chosen, decisions) if strata else (drop_one(chosen), drop_one(decisions))


def overall_bound(selection: DataFrame, alpha: str = "alpha") -> DataFrame:
    """The bound on the union, the targets mixed by the kept shares."""
    return selection.agg(
        F.min("certified").alias("certified"),
        F.count(F.lit(1)).alias("n"),
        F.avg(alpha).alias("overall_bound"),
    )


def margins(df: DataFrame, score: str, bad: str, alphas: list[float], strata: list[str] | None = None) -> DataFrame:
    """Size and bad rows of the first kept set, and the slack under each target."""
    strata = strata or []
    first = composition_curve(df, score, bad, strata, GRID[:1])
    return first.select(
        *strata,
        "n_pool",
        F.col("n_sel").alias("n1"),
        F.col("k_sel").alias("k1"),
        F.col("bad_frac").alias("u1"),
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"),
    ).withColumn("margin", F.col("alpha") - F.col("u1"))


def stratum_floor(df: DataFrame, score: str, bad: str, strata: list[str]) -> DataFrame:
    """The lowest bad fraction any grid cutoff reaches in a stratum."""
    return composition_curve(df, score, bad, strata).groupBy(*strata).agg(F.min("bad_frac").alias("floor"))


def realised_cutoffs(selection: DataFrame, scores: DataFrame, ids: list[str], score: str, stratum: str) -> DataFrame:
    """The smallest score a stored selection kept, overall (NULL stratum) and per stratum."""
    kept = selection.select(*ids).join(scores.select(*ids, score, stratum), ids)
    return kept.rollup(stratum).agg(F.min(score).alias("tau"), F.count(F.lit(1)).alias("n"))


def keep_above(df: DataFrame, score: str, taus: dict[object, float] | float, stratum: str | None = None) -> DataFrame:
    """Apply frozen cutoffs: a literal filter, so it reaches the scan and runs on streams too."""
    if stratum is None:
        return df.where(F.col(score) >= float(taus))
    ok = F.lit(False)
    for value, tau in taus.items():
        ok = ok | ((F.col(stratum) == F.lit(value)) & (F.col(score) >= float(tau)))
    return df.where(ok)
