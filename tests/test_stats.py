"""Tails against exact rationals, and budgets against published numbers."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats as S
from plumbline.operators import rates as R


def exact(lo, hi, pop, bad, draws):
    ways = sum(
        math.comb(bad, j) * math.comb(pop - bad, draws - j)
        for j in range(max(lo, 0), hi + 1)
        if j <= min(bad, draws) and 0 <= draws - j <= pop - bad
    )
    return float(Fraction(ways, math.comb(pop, draws)))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    out = []
    for _ in range(150):
        pop = rng.choice([5, 30, 100, 400, 4000, 20000])
        draws = rng.randint(0, min(pop, 600))
        out.append((pop, rng.randint(0, pop), draws, rng.randint(-1, draws + 1)))
    return out


def test_hypergeometric_tails(spark, cases):
    df = spark.createDataFrame(cases, "pop bigint, bad bigint, draws bigint, k bigint")
    args = ("k", "pop", "bad", "draws")
    rows = df.select(
        "*", S.hypergeom_cdf(*args).alias("cdf"), S.hypergeom_tail(*args).alias("tail"), S.hypergeom_pmf(*args).alias("pmf")
    ).collect()
    for r in rows:
        assert r.cdf == pytest.approx(exact(0, r.k, r.pop, r.bad, r.draws), rel=1e-9, abs=1e-13)
        assert r.tail == pytest.approx(exact(r.k, r.draws, r.pop, r.bad, r.draws), rel=1e-9, abs=1e-13)
        assert r.pmf == pytest.approx(exact(r.k, r.k, r.pop, r.bad, r.draws), rel=1e-9, abs=1e-13)


def test_tails_on_a_pool_too_large_to_enumerate(spark):
    """With 10^12 rows the draw is binomial to many digits."""
    pop, draws, k = 10**12, 400, 30
    df = spark.createDataFrame([(pop, pop // 10, draws, k)], "pop bigint, bad bigint, draws bigint, k bigint")
    got = df.select(S.hypergeom_cdf("k", "pop", "bad", "draws")).first()[0]
    want = sum(math.comb(draws, j) * 0.1**j * 0.9 ** (draws - j) for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-7)


def test_p_values_truncate_the_double_product(spark):
    row = spark.range(1).select(
        S.least_bad(0.29, 100).alias("a"),
        S.p_upper(0, 0, 50, 0.1).alias("none"),
        S.p_upper(0, 5, 5, 1.0).alias("all"),
        S.p_lower(0, 5, 5, 0.1).alias("low"),
    ).first()
    assert (row.a, row.none, row.all, row.low) == (29, 1.0, 1.0, 1.0)


def test_critical_count_is_the_largest_rejecting_count(spark):
    cells = [(n_sel, m, a) for n_sel in (40, 600, 3000) for m in (0, 1, 17, 40, 300) for a in (0.1, 0.25) if m <= n_sel]
    df = spark.createDataFrame(cells, "n_sel bigint, m bigint, a double")
    for r in df.select("*", S.critical_count("m", "n_sel", "a", 0.1).alias("k")).collect():
        ks = int(r.a * r.n_sel) + 1
        want = max([k for k in range(r.m + 1) if exact(0, k, r.n_sel, ks, r.m) <= 0.1], default=-1)
        assert max(r.k, -1) == want, r


def test_clopper_pearson_inverts_the_binomial_tail(spark):
    df = spark.createDataFrame([(0, 20), (1, 20), (20, 20), (180, 200), (599, 800)], "s bigint, n bigint")
    for r in df.select("*", S.clopper_pearson_lower("s", "n", 0.1).alias("lb")).collect():
        if r.s == 0:
            assert r.lb == 0.0
            continue
        tail = sum(math.comb(r.n, j) * r.lb**j * (1 - r.lb) ** (r.n - j) for j in range(r.s, r.n + 1))
        assert tail == pytest.approx(0.1, rel=1e-6)


# Fixed values, published results: pool 4000; (n1, k1, alpha) -> smallest budget and closed-form budget at one half.
BUDGETS = [
    (600, 20, 0.10, 250, 13939),
    (600, 20, 0.25, 60, 1432),
]
# Fixed values, published results: pool 4000, n1 603, k1 100, alpha 0.25.
POWER = {50: 0.09029717707239684, 200: 0.3453845931805842, 400: 0.5908357826855226, 800: 0.875458888938065}


def test_smallest_and_sufficient_budgets(spark):
    rows = [(i, 4000, n1, k1, a, a - k1 / n1) for i, (n1, k1, a, _, _) in enumerate(BUDGETS)]
    cells = spark.createDataFrame(rows, "cell int, n_pool bigint, n1 bigint, k1 bigint, alpha double, margin double")
    got = {r.cell: r for r in R.with_sufficient_budget(R.n_star(cells, ["cell"], 0.1, 0.5), 0.1, 0.5).collect()}
    for i, (_, _, _, n_star, bound) in enumerate(BUDGETS):
        assert (got[i].n_star, got[i].bound) == (n_star, bound)


def test_no_margin_no_budget(spark):
    cells = spark.createDataFrame([(0, 4000, 600, 120, 0.1, -0.1)], "cell int, n_pool bigint, n1 bigint, k1 bigint, alpha double, margin double")
    r = R.with_sufficient_budget(R.n_star(cells, ["cell"], 0.1, 0.5), 0.1, 0.5).first()
    assert r.n_star is None and r.bound is None


def test_exact_power(spark):
    cells = spark.createDataFrame([(0, 4000, 603, 100, 0.25)], "cell int, n_pool bigint, n1 bigint, k1 bigint, alpha double")
    got = {r.n: r.pred for r in R.pr_certify(cells, ["cell"], 0.1, F.array(*[F.lit(n) for n in POWER])).collect()}
    for n, want in POWER.items():
        assert got[n] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("draw", [R.draw_positions, R._floyd])
def test_positions_are_distinct_and_cover_the_pool(spark, draw):
    five = F.lit(5).cast("bigint")
    df = spark.range(400).select(draw(F.lit(20).cast("bigint"), five, F.col("id"), five).alias("p"))
    seen = [tuple(r.p) for r in df.collect()]
    assert all(len(set(p)) == 5 and min(p) >= 0 and max(p) < 20 for p in seen)
    counts = [sum(x in p for p in seen) for x in range(20)]
    assert min(counts) > 60 and max(counts) < 140  # 100 expected


def test_positions_of_every_size(spark):
    """The whole pool, none of it, and parts for which the stream may come short."""
    sizes = spark.createDataFrame([(n, k) for n in (1, 2, 7, 40) for k in {0, 1, n // 2, n - 1, n}], "n bigint, k bigint")
    got = sizes.select("n", "k", R.draw_positions(F.col("n"), F.lit(3), F.lit(5), F.col("k")).alias("p")).collect()
    assert all(len(set(r.p)) == len(r.p) == r.k and set(r.p) <= set(range(r.n)) for r in got)


def test_large_draws_are_linear_and_follow_the_exact_chance(spark):
    """20,000 and 90,000 labels of a pool of 100,000; rates lie around the exact probability."""
    rows = [("p", 85, 100_000, 30_000, 2_940, 0, 30_000, 2_940)]
    seg = spark.createDataFrame(rows, "pool string, q100 int, n_pool bigint, n_sel bigint, k_sel bigint, lo bigint, seg bigint, seg_bad bigint")
    counts = R.simulated_counts(seg, ["pool"], [20_000, 90_000, 200_000], 60).toPandas()
    for n, spread in ((20_000, 58), (90_000, 44), (200_000, 0)):
        m = counts[counts.n == n].m
        assert len(m) == 60 and abs(m.mean() - min(n, 100_000) * 0.3) <= 4 * spread / 60**0.5 and m.std() <= 1.5 * spread
        k = counts[counts.n == n].k
        assert abs(k.mean() - min(n, 100_000) * 0.0294) <= 4 * 24 / 60**0.5
    small = spark.createDataFrame([("p", 85, 900, 300, 24, 0, 300, 24)], seg.schema)
    rate = {r.n: r.cert_rate for r in R.certification_rate(small, ["pool"], [200, 600], 500, [0.1], 0.1).collect()}
    exact = {r.n: r.pred for r in R.pr_certify(R.first_cells(small, ["pool"], [0.1]), ["pool", "alpha"], 0.1, F.array(F.lit(200), F.lit(600))).collect()}
    for n in (200, 600):
        assert abs(rate[n] - exact[n]) <= 4 * (exact[n] * (1 - exact[n]) / 500) ** 0.5 + 0.01


def test_false_certification_stays_below_delta(spark):
    """A pool just above the target: certificates are false, and rarer than delta."""
    rows = [("p", 85, 2000, 300, 31, 0, 300, 31), ("p", 50, 2000, 1000, 105, 300, 700, 74)]
    seg = spark.createDataFrame(rows, "pool string, q100 int, n_pool bigint, n_sel bigint, k_sel bigint, lo bigint, seg bigint, seg_bad bigint")
    r = R.certification_rate(seg, ["pool"], [200], 400, [0.1], 0.1).first()
    assert r.false_rate == r.cert_rate and r.false_rate <= 0.13


def test_the_whole_pool_is_a_budget(spark):
    """Only labelling all 37 rows reaches the target; the chance is no more than 1."""
    cells = spark.createDataFrame([("p", 37, 30, 4, 0.2, 1.0)], "cell string, n_pool long, n1 long, k1 long, alpha double, margin double")
    chance = {r.n: r.pred for r in R.pr_certify(cells, ["cell"], 0.1, F.sequence(F.lit(1), F.lit(37))).collect()}
    assert max(chance.values()) <= 1.0 and chance[37] == 1.0
    target = (max(chance[10], chance[20], chance[30]) + 1.0) / 2
    assert R.n_star(cells, ["cell"], 0.1, target).first().n_star == 37
