"""Rank cuts, draws and curves against plain sorting, on skewed data."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import tie_key
from plumbline.operators import arms as A
from plumbline.operators import certify as C
from plumbline.operators import metrics as M
from plumbline.operators import ranking as R
from plumbline.operators import sampling as P


def key(tag, seed, i):
    return hashlib.md5(f"{tag}:{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 3000
    score = np.where(rng.random(n) < 0.35, 1.0, np.round(rng.normal(size=n), 2))  # a third in one tie
    group = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    return pd.DataFrame({"id": np.arange(n), "score": score, "group": group, "bad": rng.random(n) < 0.3})


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data).repartition(5).cache()


def ordered(df, desc=True):
    return df.assign(o=-df.score if desc else df.score, k=[key("tie", 0, i) for i in df.id]).sort_values(["o", "k"])


@pytest.mark.parametrize("k", [0, 1, 700, 1400, 2999, 3000, 5000])
def test_top_k(rows, data, k):
    got = {r.id for r in A.select_top(rows, "score", ["id"], k=k).collect()}
    assert got == set(ordered(data).id[:k])


def test_top_fraction_truncates(rows, data):
    got = {r.id for r in A.select_top(rows, "score", ["id"], frac=0.8).collect()}
    assert got == set(ordered(data).id[: int(0.8 * len(data))])


@pytest.mark.parametrize("n", [10, 2500])
def test_exact_sample_does_not_depend_on_partitions(rows, data, n):
    want = set(sorted(data.id, key=lambda i: key("pool", 9, i))[:n])
    assert {r.id for r in P.sample_exact(rows, n, 9, ["id"]).collect()} == want
    assert {r.id for r in P.sample_exact(rows.coalesce(1), n, 9, ["id"]).collect()} == want


def test_quota_per_stratum(spark, rows, data):
    wants = (("hot", 1500), ("a", 10), ("b", int((data.group == "b").sum())))
    got = P.sample_per_stratum(rows, ["group"], spark.createDataFrame(wants, "group string, quota bigint"), 1, ["id"]).toPandas()
    for g, q in wants:
        ids = data.id[data.group == g]
        assert set(got.id[got.group == g]) == set(sorted(ids, key=lambda i: key("strata", 1, i))[:q])


def test_top_per_stratum_with_ties(spark, rows, data):
    ks = spark.createDataFrame([("hot", 900), ("a", 0)], "group string, k bigint")
    got = A.select_top_per_stratum(rows, "score", ["group"], ks, ["id"]).toPandas()
    assert set(got.id) == set(ordered(data[data.group == "hot"]).id[:900])


def test_deciles_split_ties_exactly(rows, data):
    got = A.with_decile(rows, "score", ["id"]).toPandas().set_index("id").decile
    for d, block in enumerate(np.array_split(ordered(data).id.to_numpy(), 10)):
        assert (got.loc[block] == d).all()


def test_bands_put_the_remainder_last(rows, data):
    sub = data[data.id < 2000]
    got = A.with_rank_band(rows.where("id < 2000"), "score", ["id"]).toPandas().set_index("id").band
    third = len(sub) // 3
    want = np.minimum(np.arange(len(sub)) // third, 2)
    assert (got.loc[ordered(sub).id].to_numpy() == want).all()


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_edges_never_change_the_answer(rows, data, buckets):
    edges = R.value_edges(rows, "score", buckets, rows_each=1)
    got = R.value_cuts(rows, "score", R.cuts_of((0, "n_total div 2"), (1, "n_total"), (2, "n_total + 1")), edges=edges).toPandas()
    s = np.sort(data.score)
    got = got.set_index("cut")
    assert list(got.index.sort_values()) == [0, 1]
    assert got.value[0] == s[len(s) // 2 - 1] and got.value[1] == s[-1]
    assert got.below[0] == (s < got.value[0]).sum() and got.ties[0] == (s == got.value[0]).sum()


def test_grid_keeps_what_numpy_quantiles_keep(rows, data):
    got = C.composition_curve(rows, "score", "bad", ["group"]).toPandas()
    for g, part in data.groupby("group"):
        for r in got[got.group == g].itertuples():
            x = np.sort(part.score)
            tau = x[-(-(len(x) - 1) * r.q100 // 100)]
            kept = part[part.score >= tau]
            assert (r.tau, r.n_sel, r.k_sel) == (tau, len(kept), kept.bad.sum())
            loose = part[part.score >= np.quantile(part.score, r.q100 / 100)]
            assert len(loose) in (r.n_sel, r.n_sel - (part.score == tau).sum())


def test_curve_matches_sorting(rows, data):
    one = F.lit(1).cast("bigint")
    got = R.value_curve(rows, "score", {"n": one, "b": F.col("bad").cast("bigint")}, ["group"]).toPandas()
    for r in got.itertuples():
        part = data[data.group == r.group]
        assert r.below_n == (part.score < r.score).sum() and r.below_b == part.bad[part.score < r.score].sum()
        assert r.total_n == len(part)


def test_auroc_and_spearman(rows, data):
    pos, neg = data.score[data.bad].to_numpy(), data.score[~data.bad].to_numpy()
    want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert M.auroc(rows, "score", "bad").first()[0] == pytest.approx(want, abs=1e-12)
    other = rows.withColumn("y", F.col("score") * 2 + F.col("id") % 7)
    y = data.score * 2 + data.id % 7
    rank_corr = np.corrcoef(data.score.rank(), y.rank())[0, 1]
    assert M.spearman(other, "score", "y", []).first()["spearman"] == pytest.approx(rank_corr, abs=1e-10)


def test_length_matching_tops_up(spark, data):
    rng = np.random.default_rng(1)
    pdf = data.assign(length=rng.integers(1, 200, len(data)), stratum=np.where(data.id % 3 == 0, "demo", "benign"))
    df = spark.createDataFrame(pdf)
    ref = df.where("length > 150 and score > 0.5")
    wants = {"demo": 600, "benign": 700}
    got = A.select_length_matched(df, ref, "length", "stratum", wants, 4, ["id"]).toPandas()
    assert len(got) == 1300 and got.id.is_unique
    edges = A.decile_edges(ref, "length")
    lens = pdf.length[(pdf.length > 150) & (pdf.score > 0.5)]
    assert np.allclose(edges, np.quantile(lens, np.linspace(0, 1, 11))[1:-1])


def test_certified_selection_keeps_whole_strata_apart(rows, data):
    cal = P.calibration_draw(rows, 400, 0, ["id"])
    kept, dec = C.certified_selection(rows, cal, "score", "bad", 0.5, 0.1, ["id"], ["group"])
    got, dec = kept.toPandas(), {r.group: r for r in dec.collect()}
    for g, d in dec.items():
        part = data[data.group == g]
        want = set(part.id[part.score >= d.tau]) if d.certified else set(ordered(part).id[: d.keep])
        assert set(got.id[got.group == g]) == want
    bound = C.overall_bound(kept).first()
    assert bound.n == len(got) and bound.overall_bound == pytest.approx(0.5)


def test_keys_are_the_documented_md5(rows):
    r = rows.select("id", tie_key("id").alias("k")).first()
    assert r.k == key("tie", 0, r.id)


def test_short_quotas_raise(spark, rows):
    quotas = spark.createDataFrame([("hot", 1), ("b", 99999), ("none", 1)], "group string, quota bigint")
    with pytest.raises(ValueError, match="too few rows"):
        P.sample_per_stratum(rows, ["group"], quotas, 1, ["id"])
    assert {r["group"] for r in P.shortfalls(rows, ["group"], quotas)} == {"b", "none"}


def test_positions_follow_the_key(rows, data):
    got = R.with_position(rows, P.draw_key("pool", 2, "id"), "position").toPandas().set_index("id").position
    assert [got[i] for i in sorted(data.id, key=lambda i: key("pool", 2, i))] == list(range(len(data)))


def test_rows_without_a_score_have_no_rank(spark):
    rows = [(i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, score double").repartition(3)
    scored = [i for i in range(60) if i % 3 == 2]
    assert {r.id for r in A.select_top(df, "score", ["id"], k=5).collect()} == set(scored[-5:])
    assert {r.id for r in A.select_bottom(df, "score", ["id"], 5).collect()} == set(scored[:5])
    assert {r.id for r in A.select_top(df, "score", ["id"], k=99).collect()} == set(scored)
    deciles = {r.id: r.decile for r in A.with_decile(df, "score", ["id"]).collect()}
    assert all((deciles[i] is None) == (i not in scored) for i in range(60))
    assert sorted(deciles[i] for i in scored) == [d for d in range(10) for _ in range(2)]


def test_sizes_are_exact_where_ids_repeat(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(700)], "id long, row long").repartition(4)
    for n in (1, 30, 100, 101, 699, 700, 900):
        assert P.sample_exact(df, n, 1, ["id"]).count() == min(n, 700)
    flat = df.withColumn("score", F.lit(1.0))
    assert A.select_top(flat, "score", ["id"], k=155).count() == 155
    assert sorted(r["count"] for r in A.with_decile(flat, "score", ["id"]).groupBy("decile").count().collect()) == [70] * 10


def test_error_is_split_over_all_strata_and_none_may_lack(spark):
    rows = [(i, i % 3, float(i % 50), i % 50 < 5) for i in range(900)]
    pool = spark.createDataFrame(rows, "id long, g long, score double, bad boolean").repartition(3)
    cal = P.calibration_draw(pool, 300, 0, ["id"])
    _, three = C.certified_selection(pool, cal, "score", "bad", 0.1, 0.09, ["id"], ["g"])
    one = {
        r.g: (r.certified, r.tau)
        for g in range(3)
        for r in C.certified_selection(pool.where(F.col("g") == g), cal.where(F.col("g") == g), "score", "bad", 0.1, 0.03, ["id"], ["g"])[1].collect()
    }
    assert {r.g: (r.certified, r.tau) for r in three.collect()} == one
    with pytest.raises(ValueError, match="without a stratum"):
        C.certified_selection(pool.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), cal, "score", "bad", 0.1, 0.1, ["id"], ["g"])


def test_large_buckets_are_cut_again(spark):
    """Eight buckets over 10^5 distinct values, and huge groups of ties: several levels give the same cuts as one."""
    value = F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 100_003).cast("double"))
    df = spark.range(150_000).select((F.col("id") % 2).cast("string").alias("s"), value.alias("v"))
    cuts = R.cuts_of((0, "1"), (1, "n_total div 2"), (2, "n_total div 2 + 1"), (3, "n_total"), (4, "n_total + 1"), (5, "n_total * 9 div 10"))
    for strata in ([], ["s"]):
        want = sorted(map(tuple, R.value_cuts(df, "v", cuts, strata).collect()))
        edges = R.value_edges(df, "v", 8, rows_each=1)
        got = sorted(map(tuple, R.value_cuts(df, "v", cuts, strata, edges, most=100, buckets=8).collect()))
        assert got == want and len(got) == 5 * (2 if strata else 1)
    pdf = df.toPandas().v.sort_values().to_numpy()
    median = R.value_cuts(df, "v", R.cuts_of((0, "n_total div 2")), [], edges, most=100, buckets=8).first()
    assert median.value == pdf[75_000 - 1]
