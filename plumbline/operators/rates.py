"""Certification rates: simulated, exact, and the label budgets they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw_key, hex_number
from plumbline.functions.stats import (
    critical_count,
    hypergeom_cdf,
    hypergeom_pmf,
    least_bad,
    p_lower,
    p_upper,
    sufficient_budget,
)
from plumbline.operators.certify import GRID, _flag, grid_thresholds, kept_counts
from plumbline.session import pin

# Mass below which a calibration count is ignored, and the budget search.
NEGLIGIBLE = 1e-12
BUDGET_STEP = 10
FIRST_BUDGETS = 4000


def kept_segments(
    df: DataFrame, score: str, bad: str, keys: list[str], wanted: str | None = None, grid: tuple[int, ...] = GRID
) -> DataFrame:
    """What a simulated draw needs to know of each pool, pinned: nested kept sets and their labels.

    One row per (keys, q100) with ``n_sel``, ``k_sel`` and the part of the pool
    each cutoff adds to the more selective one before it: ``lo`` (first
    position), ``seg`` (rows), ``seg_bad`` and ``seg_wanted``.
    """
    taus = grid_thresholds(df, score, keys, grid)
    measures = {"k_sel": _flag(bad)}
    if wanted:
        measures["w_sel"] = _flag(wanted)
    full = taus.join(kept_counts(df, score, taus, measures, keys, grid), [*keys, "q100"])
    before = Window.partitionBy(*keys).orderBy(F.desc("q100"))
    out = full
    for total, part in (("n_sel", "seg"), ("k_sel", "seg_bad"), ("w_sel", "seg_wanted")):
        if total in full.columns:
            out = out.withColumn(part, F.col(total) - F.coalesce(F.lag(total).over(before), F.lit(0)))
    return pin(out.withColumn("lo", F.col("n_sel") - F.col("seg")))


def _floyd(n_pool: Column, n: Column, draw: Column, size: Column) -> Column:
    """Distinct positions by Floyd's method: number j of the loop, or j itself when its number is taken."""

    def add(chosen: Column, j: Column) -> Column:
        number = hex_number(draw_key("floyd", draw, n, j)) % (j + 1)
        return F.array_append(chosen, F.when(F.array_contains(chosen, number), j).otherwise(number))

    empty = F.lit([]).cast("array<bigint>")
    return F.when(size > 0, F.aggregate(F.sequence(n_pool - size, n_pool - 1), empty, add)).otherwise(empty)


def draw_positions(n_pool: Column, n: Column, draw: Column, size: Column | None = None) -> Column:
    """``size`` (``n`` unless given) distinct uniform positions in [0, n_pool).

    The first distinct ones of a stream of hashed numbers, which gives every subset
    the same chance. The cost is linear in the labels and does not depend on the pool. The stream is as long
    as half a pool can need; where it comes short, for larger parts of a pool above all,
    Floyd's method draws, at the square of the labels.
    """
    size = (n if size is None else size).cast("bigint")
    share = F.least(size / n_pool, F.lit(0.5))
    need = F.ceil(8 * F.sqrt(size.cast("double")) - n_pool * F.log1p(-share)) + 32
    stream = F.transform(F.sequence(F.lit(0).cast("bigint"), need - 1), lambda i: hex_number(draw_key("mc", draw, n, i)) % n_pool)
    return F.transform(
        F.array(F.array_distinct(stream)),
        lambda a: F.when(F.size(a) >= size, F.slice(a, F.lit(1), size.cast("int"))).otherwise(_floyd(n_pool, n, draw, size)),
    )[0]


def simulated_counts(segments: DataFrame, keys: list[str], ns: list[int], draws: int) -> DataFrame:
    """Calibration counts of many draws: (keys, n, draw, q100, n_sel, k_sel, m, k[, w]).

    A draw only matters through how many of its rows, and of its bad rows, each
    kept set holds. So positions are drawn against the counted segments instead
    of the pool: exactly the same distribution, and the pool is never
    multiplied by the number of draws. A size above the pool draws the whole pool. Of a size above
    half the pool the rows left out are drawn, so the cost is linear in the smaller part.
    """
    spark = segments.sparkSession
    pools = segments.select(*keys, "n_pool").distinct()
    jobs = pools.select(
        *keys,
        "n_pool",
        F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in ns])).alias("n"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = (
        jobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        .repartition(parts, *keys, "n", "draw")
        .withColumn("_left", F.greatest(F.col("n_pool") - F.col("n"), F.lit(0)))
        .withColumn("_few", F.least(F.col("n"), F.col("_left")))
        .withColumn("_at", draw_positions(F.col("n_pool"), F.col("n"), F.col("draw"), F.col("_few")))
        .drop("n_pool")
    )

    def within(size: str) -> Column:
        hi = F.col("lo") + F.col(size)
        hits = F.size(F.filter("_at", lambda p: (p >= F.col("lo")) & (p < hi))).cast("bigint")
        return F.when(F.col("_left") < F.col("n"), F.col(size) - hits).otherwise(hits)

    deep = (
        Window.partitionBy(*keys, "n", "draw")
        .orderBy(F.desc("q100"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = drawn.join(segments, keys).select(
        *keys, "n", "draw", "q100", "n_pool", "n_sel", "k_sel",
        within("seg").alias("_m"),
        within("seg_bad").alias("_k"),
        *([within("seg_wanted").alias("_w")] if "seg_wanted" in segments.columns else []),
    )
    for c in ("m", "k", "w"):
        if f"_{c}" in out.columns:
            out = out.withColumn(c, F.sum(f"_{c}").over(deep)).drop(f"_{c}")
    return out


def certification_rate(
    segments: DataFrame,
    keys: list[str],
    ns: list[int],
    draws: int,
    alphas: list[float],
    delta: float,
    deep: bool = True,
) -> DataFrame:
    """Share of draws that certify, and that certify a set above the target.

    ``deep`` walks the whole grid; otherwise only the first cutoff is tested,
    as the gate does. Means are over the certified draws.
    """
    use = segments
    if not deep:
        first = segments.groupBy(*keys).agg(F.max("q100").alias("q100"))
        use = segments.join(first, [*keys, "q100"])
    counts = simulated_counts(use, keys, ns, draws)
    tests = counts.select(
        "*", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    ).withColumn("ok", p_upper("k", "m", "n_sel", "alpha") <= delta)
    return _rates(tests, [*keys, "n", "alpha"], F.col("alpha"))


def _rates(tests: DataFrame, by: list[str], target: Column) -> DataFrame:
    down = (
        Window.partitionBy(*by, "draw")
        .orderBy(F.desc("q100"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    size = F.struct("q100", "n_sel", "k_sel")
    deployed = (
        tests.withColumn("ok", F.min("ok").over(down))
        .groupBy(*by, "draw")
        .agg(F.min_by(size, F.when(F.col("ok"), F.col("q100"))).alias("_d"))
        .select(*by, "draw", "_d.*")
        .withColumn("contam", F.col("k_sel") / F.col("n_sel"))
    )
    return deployed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg(F.col("q100").isNotNull().cast("double")).alias("cert_rate"),
        F.avg(F.coalesce(F.col("contam") > target, F.lit(False)).cast("double")).alias("false_rate"),
        (F.avg("q100") / 100).alias("mean_q"),
        F.avg("contam").alias("mean_contam"),
        F.avg("n_sel").alias("mean_size"),
    )


def two_property_rate(
    segments: DataFrame, keys: list[str], ns: list[int], draws: int, alpha: float, beta: Column, delta: float
) -> DataFrame:
    """D9 over many draws: how often both properties certify on one walk."""
    counts = simulated_counts(segments, keys, ns, draws).withColumn("beta", beta)
    ok = F.greatest(
        p_upper("k", "m", "n_sel", alpha),
        p_lower("w", "m", "n_sel", "beta"),
    )
    return _rates(counts.withColumn("ok", ok <= delta / 2), [*keys, "n"], F.lit(float(alpha)))


def first_cells(segments: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """(n_pool, n1, k1, u1, alpha, margin) of each pool's first kept set."""
    first = segments.groupBy(*keys).agg(
        F.max("n_pool").alias("n_pool"),
        F.max_by("n_sel", "q100").alias("n1"),
        F.max_by("k_sel", "q100").alias("k1"),
    )
    return first.select(
        "*",
        (F.col("k1") / F.col("n1")).alias("u1"),
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"),
    ).withColumn("margin", F.col("alpha") - F.col("u1"))


def _power_by_count(cells: DataFrame, keys: list[str], delta: float, budget: Column) -> DataFrame:
    """(keys, m, power): chance to reject given m calibration rows inside the first set.

    Does not depend on the budget, so one table serves every n.
    """
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crit = critical_count("m", "n1", "alpha", delta)
    return (
        cells.select(
            *keys, "n_pool", "n1", "k1", "alpha",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(budget.cast("bigint"), F.col("n1")))).alias("m"),
        )
        .repartition(parts, *keys, "m")
        .withColumn("_crit", crit)
        .select(
            *keys, "m",
            F.when(F.col("_crit") < 0, F.lit(0.0))
            .otherwise(hypergeom_cdf("_crit", "n1", "k1", "m"))
            .alias("power"),
        )
    )


def pr_certify(cells: DataFrame, keys: list[str], delta: float, ns: Column) -> DataFrame:
    """Exact probability that the first cutoff certifies, per cell and budget.

    ``cells``: one row per ``keys`` with n_pool, n1, k1, alpha; ``ns`` an array
    column of budgets. Sum over the calibration count m of its chance times the
    chance to reject given m; counts of negligible mass are skipped. A target no
    set of this size can exceed certifies always. A budget above the pool labels the whole pool.
    """
    cells = pin(cells.withColumn("_ns", ns.cast("array<bigint>")))
    cells = cells.withColumn("_top", F.least(F.array_max("_ns"), F.col("n_pool")))
    power = _power_by_count(cells, keys, delta, F.col("_top"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # m concentrates around n * n1 / n_pool: outside +-(8 sd + 8) its mass is negligible
    share = F.col("n1") / F.col("n_pool")
    spread = 8 * F.sqrt(F.col("_n") * share * (1 - share)) + 8
    lo = F.greatest(F.lit(0.0), F.floor(F.col("_n") * share - spread)).cast("bigint")
    hi = F.least(F.ceil(F.col("_n") * share + spread).cast("bigint"), F.col("_n"), F.col("n1"))
    mass = hypergeom_pmf("m", "n_pool", "n1", "_n")
    grid = (
        cells.select(*keys, "n_pool", "n1", "alpha", F.explode("_ns").alias("n"))
        .withColumn("_n", F.least("n", "n_pool"))
        .repartition(parts, *keys, "n")
        .select("*", F.explode(F.sequence(lo, hi)).alias("m"))
        .withColumn("_mass", mass)
        .where(F.col("_mass") >= NEGLIGIBLE)
    )
    total = grid.join(power, [*keys, "m"]).groupBy(*keys, "n", "n1", "alpha").agg(
        F.sum(F.col("_mass") * F.col("power")).alias("_pr")
    )
    always = least_bad("alpha", "n1") > F.col("n1")
    return total.select(*keys, "n", F.when(always, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_pr"))).alias("pred"))


def n_star(
    cells: DataFrame, keys: list[str], delta: float, target: float, step: int = BUDGET_STEP, first: int = FIRST_BUDGETS,
) -> DataFrame:
    """The smallest budget in steps of ``step``, or the pool itself, reaching ``target``; NULL without margin or success.

    The searched range starts with budgets up to ``first`` and is doubled, for the cells
    still without an answer, until it passes their pool. Every budget of a range is tried, as the
    chance need not grow with the budget.
    """
    usable = pin(cells.where("margin > 0"))
    lo, hi, answers = 0, max(step, first // step * step), None
    while True:
        ns = F.filter(F.sequence(F.lit(lo + step), F.lit(hi), F.lit(step)), lambda n: n <= F.col("n_pool"))
        census = (F.col("n_pool") > lo) & (F.col("n_pool") <= hi) & (F.col("n_pool") % step != 0)
        ns = F.when(census, F.array_append(ns, F.col("n_pool"))).otherwise(ns)
        reached = pin(
            pr_certify(usable, keys, delta, ns)
            .where(F.col("pred") >= target)
            .groupBy(*keys)
            .agg(F.min("n").alias("n_star"))
        )
        answers = reached if answers is None else answers.unionByName(reached)
        usable = pin(usable.where(F.col("n_pool") > hi).join(reached, keys, "left_anti"))
        if usable.isEmpty():
            return cells.join(answers, keys, "left")
        lo, hi = hi, 2 * hi


def with_sufficient_budget(cells: DataFrame, delta: float, target: float) -> DataFrame:
    """The closed-form budget beside each cell."""
    return cells.withColumn("bound", sufficient_budget("n_pool", "n1", "margin", delta, target))


def first_budget(sweep: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The first measured budget whose rate reaches ``target``."""
    return sweep.groupBy(*keys).agg(F.min(F.when(F.col("rate") >= target, F.col("n"))).alias("measured_first"))


def label_complexity(
    segments: DataFrame, keys: list[str], ns: list[int], draws: int, alphas: list[float], delta: float
) -> DataFrame:
    """Measured rate, false rate and exact prediction for every pool, scorer, target and budget."""
    measured = certification_rate(segments, keys, ns, draws, alphas, delta).select(
        *keys, "alpha", "n", F.col("cert_rate").alias("rate"), F.col("false_rate").alias("false_cert")
    )
    cells = pin(first_cells(segments, keys, alphas))
    budgets = F.array(*[F.lit(int(n)) for n in ns])
    predicted = pr_certify(cells, [*keys, "alpha"], delta, budgets)
    return measured.join(predicted, [*keys, "alpha", "n"]).join(
        cells.select(*keys, "alpha", "n1", "k1", "u1", "margin"), [*keys, "alpha"]
    )


def prediction_quality(sweep: DataFrame) -> DataFrame:
    """How well the exact prediction tracks the measurement over all cells."""
    from plumbline.operators.metrics import spearman

    rho = spearman(sweep, "pred", "rate", [])
    size = sweep.agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(F.abs(F.col("pred") - F.col("rate"))).alias("mae"),
        F.max("false_cert").alias("max_false"),
    )
    one = F.lit(0).alias("_one")
    return size.select("*", one).join(rho.select("spearman", one), "_one").drop("_one")
