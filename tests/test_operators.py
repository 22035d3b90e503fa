"""Text, spectral, storage, audit and stream behaviour on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import audit as H
from plumbline.operators import certify as C
from plumbline.operators import metrics as M
from plumbline.operators import pools as P
from plumbline.operators import reports as Rep
from plumbline.operators import scoring as S
from plumbline.operators import spectral as X
from plumbline.plans import views as V
from plumbline.plans.registry import Tables
from plumbline.sources import readers as R
from plumbline.sources import sinks as W
from plumbline.streaming import frozen_filter, keep_above


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_length_matches_the_table():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a = [str(x) for x in rng.integers(0, 5, rng.integers(1, 90))]
        b = [str(x) for x in rng.integers(0, 5, rng.integers(1, 90))]
        assert M._lcs_length(a, b) == dp_lcs(a, b)


def test_rouge_takes_the_best_reference(spark):
    gens = spark.createDataFrame([("m", 1, "p", "The cat sat"), ("m", 2, "q", "x"), ("m", 3, "none", "y")], "model string, item int, prompt string, response string")
    refs = spark.createDataFrame([("p", "a dog ran"), ("p", "the CAT sat down"), ("q", "")], "prompt string, response string")
    r = M.rouge_l(gens, refs, "prompt", ["model"], "item").first()
    assert r.n_prompts == 2 and r.rouge_l == pytest.approx((2 * 1 * 0.75 / 1.75 + 0) / 2)


def test_spectral_scores_match_svd(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(z)], "id int, v array<double>")
    got = X.spectral_scores(df, "v", 3).orderBy("id").toPandas()
    c = z - z.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    for k in (1, 2, 3):
        assert np.allclose(got[f"s{k}"], ((c @ vt[:k].T) ** 2).sum(1) / k)


def test_spectral_layers_in_one_pass_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(200, 6)) @ np.diag([4, 3, 2, 1, 0.5, 0.2]) + 1000
    y = rng.normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    rows = [(i, i % 3 == 0, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(z, y))]
    odd = [(200, True, None, None), (201, False, [float("nan")] * 6, [1.0, None, 1.0, 1.0]), (202, True, [float("inf")] * 6, None)]
    df = spark.createDataFrame(rows + odd, "id int, bad boolean, v array<double>, w array<double>").repartition(5)
    got = X.layer_scores(df, {"a": "v", "b": "w"}, 2, ["id"]).toPandas().set_index(["layer", "k", "id"]).score
    assert len(got) == 2 * 2 * 203
    for name, x in (("a", z), ("b", y)):
        c = x - x.mean(0)
        vt = np.linalg.svd(c, full_matrices=False)[2]
        for k in (1, 2):
            one = got[name][k].sort_index()
            assert np.allclose(one[:200], ((c @ vt[:k].T) ** 2).sum(1) / k) and one[200:].isna().all()
    auc = X.spectral_auc(df, {"a": "v", "b": "w"}, "bad", [1, 2])
    assert auc.count() == 4 and auc.where("auroc between 0 and 1").count() == 4
    empty = df.where("id < 0")
    assert X.spectral_scores(empty, "v", 2).count() == 0
    assert X.spectral_scores(df.where("id = 200"), "v", 2).first().s1 is None


def test_pluggable_scorer_sees_batches(spark):
    df = spark.range(50).withColumn("text", F.col("id").cast("string"))

    def make():
        def score(part):
            assert len(part) <= 7
            return part["text"].str.len().astype("float64")

        return score

    got = S.score_with(df, make, ["text"], "score double", batch=7).toPandas()
    assert len(got) == 50 and (got.score == got.text.str.len()).all()


def test_score_missing_leaves_the_cache_alone(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "model string, x int")
    cache = spark.createDataFrame([("a", 9.0)], "model string, score double")
    got = {r.model: r.score for r in S.score_missing(items, cache, ["model"], lambda d: d.withColumn("score", F.lit(1.0))).collect()}
    assert got == {"a": 9.0, "b": 1.0}


def test_refusals_and_verdicts(spark):
    texts = ["  i'm SORRY, no", "No, never", "Nothing", "Well, I cannot", "It's not appropriate"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.is_refusal("t")).collect()] == [True, True, False, False, True]
    v = spark.createDataFrame([("Harmful request:  Yes\nx",), ("harmful request: nooo yes",), ("other",)], "t string")
    assert [r[0] for r in v.select(T.parse_verdict("t", "harmful request:")).collect()] == [True, False, False]


def test_keep_first_on_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), (999 - F.col("id")).alias("pos"), "id")
    got = {r.k: r.id for r in P.keep_first(df, ["k"], ["pos"]).collect()}
    assert len(got) == 301 and got["hot"] == 699


def test_examples_gzip_pool_and_arrays(spark, tmp_path):
    rows = [("p", "r", True), ("q", 's "x"', False)]
    df = spark.createDataFrame(rows, R.EXAMPLE)
    df.write.option("compression", "gzip").json(str(tmp_path / "gz"))
    assert sorted(map(tuple, R.read_examples(spark, str(tmp_path / "gz")).collect())) == rows
    (tmp_path / "pool.json").write_text(json.dumps([dict(zip(("prompt", "response", "is_safe"), r)) for r in rows]))
    assert [tuple(r) for r in R.read_pool(spark, str(tmp_path / "pool.json")).orderBy("pool_id").collect()] == [(0, *rows[0]), (1, *rows[1])]
    (tmp_path / "s.json").write_text(json.dumps({"a": [1.5, 2.5], "b": [True, False]}))
    got = R.read_score_arrays(spark, str(tmp_path / "s.json"), {"a": "double", "b": "boolean"}).collect()
    assert [tuple(r) for r in got] == [(0, 1.5, True), (1, 2.5, False)]
    (tmp_path / "bad.json").write_text(json.dumps({"a": [1.5], "b": [True, False]}))
    with pytest.raises(Exception, match="differ in length"):
        R.read_score_arrays(spark, str(tmp_path / "bad.json"), {"a": "double", "b": "boolean"}).collect()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Behavior,Kind\n"a, ""b""",standard\nc,other\n')
    df = R.read_csv(spark, str(tmp_path / "h.csv"), "Behavior string, Kind string", F.col("Kind") == "standard")
    assert [r.Behavior for r in df.collect()] == ['a, "b"']
    (tmp_path / "category_1.csv").write_text("  one \n\ntwo\n")
    (tmp_path / "category_2.csv").write_text("three\n")
    got = R.read_categorised_csv(spark, str(tmp_path / "category_*.csv")).collect()
    assert sorted(map(tuple, got)) == [("category_1", "one"), ("category_1", "two"), ("category_2", "three")]


def test_selection_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "sel")
    first = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("y", 0, 3)], "arm string, seed int, id bigint")
    W.write_selection(first, path)
    W.write_selection(spark.createDataFrame([("x", 1, 7)], "arm string, seed int, id bigint"), path)
    got = sorted((r.arm, r.seed, r.id) for r in spark.read.parquet(path).collect())
    assert got == [("x", 0, 1), ("x", 1, 7), ("y", 0, 3)]


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert W.read_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert calls == [1]


def test_flatten_json_skips_booleans_and_reads_lists_whole(spark):
    doc = {"a": {"b": [1, 2.5, True, "3"], "c": None}, "d": -4}
    df = spark.createDataFrame([("f", json.dumps(doc)), ("g", json.dumps({"l": list(range(100))}))], "file string, json string")
    got = {(r.file, r.path): r.value for r in H.flatten_json(df, "file", "json").collect()}
    assert {k: v for k, v in got.items() if k[0] == "f"} == {("f", "/a/b[0]"): 1.0, ("f", "/a/b[1]"): 2.5, ("f", "/d"): -4.0}
    assert sum(k[0] == "g" for k in got) == 100
    assert H.flatten_json(df, "file", "json", list_limit=60).where("file = 'g'").count() == 60
    bad = spark.createDataFrame([("x", "{"), ("y", None), ("z", "1")], "file string, json string")
    assert sorted(tuple(r) for r in H.malformed_json(bad, "file", "json").collect()) == [("x", "not JSON"), ("y", "no text")]
    assert H.flatten_json(df, "file", "json", None).count() == 103


def test_numbers_with_context_and_tracing(spark):
    text = "Harm was 0.45 here, in 2024, at 0.10. " + "y" * 40 + " We ran 12 epochs, and " + "x" * 70 + " then 33.3 and v1.25 or 0.10 so."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {r.literal: r.pos for r in H.extract_numbers(df, ["id"], "text").collect()}
    assert got == {"0.45": text.index("0.45"), "33.3": text.index("33.3")}
    values = spark.createDataFrame([(-0.4512,), (0.333,), (8.0,)], "value double")
    found = {(r.literal, r.value) for r in H.trace(H.extract_numbers(df, ["id"], "text"), values).collect()}
    assert found == {("0.45", -0.4512), ("33.3", 0.333)}


def test_json_nested_deep_with_brackets_in_strings(spark):
    deep = {"a": [{"b": {"c": [[7]]}}, "[[[[{{", 'q"]'], "e": {}, "f": [], "n": None, "t": 0.5}
    df = spark.createDataFrame([("f", json.dumps(deep)), ("g", "3"), ("bad", '{"x": 1')], "file string, json string")
    got = {(r.file, r.path): r.value for r in H.flatten_json(df, "file", "json").collect()}
    assert got == {("f", "/a[0]/b/c[0][0]"): 7.0, ("f", "/t"): 0.5, ("g", ""): 3.0}
    assert H.flatten_json(df.where("file = 'bad'"), "file", "json").count() == 0


def test_numbers_far_apart_many_and_among_wide_characters(spark):
    import re

    text = "😀 12.5 " + "é 77 \n" * 300 + "\u0001 and -31 32- 4.5% 1.2.3 v44 55 " + "😀" * 70 + " 6.25"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no")], "id int, text string")
    want = [(m.start(), m[1]) for m in re.finditer(r"(?<![\w.\-])(\d+\.\d+|\d{2,})(?![\w.%])", text, re.A)]
    got = H.extract_numbers(df, ["id"], "text", False).collect()
    assert sorted((r.pos, r.literal) for r in got) == want and len(want) > 300
    assert sorted((r.pos, r.literal) for r in H.extract_numbers(df, ["id"], "text").collect()) == want
    plan = H.extract_numbers(df, ["id"], "text")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("(?![") == 1


def test_tracing_of_large_values_and_as_printed(spark):
    literals = spark.createDataFrame([("12",), ("2.67",), ("2.68",), ("007",), ("0.12345678901234567",), ("27.6",), ("10000000000000000905969664",)], "literal string")
    values = spark.createDataFrame([(12.0,), (1e25,), (2.675,), (-7.2,), (None,), (float("nan"),), (float("inf"),), (0.276,)], "value double")
    got = {(r.literal, r.value) for r in H.trace(literals, values).collect()}
    assert got == {("12", 12.0), ("2.67", 2.675), ("2.68", None), ("007", -7.2), ("0.12345678901234567", None), ("27.6", 0.276), ("10000000000000000905969664", 1e25)}


def test_tracing_by_scope(spark):
    rows = [(1, "Random reaches 0.45", "0.45"), (2, "certified reaches 0.45", "0.45"), (3, "Nothing named: 0.45", "0.45"), (4, "random 0.99", "0.99"),
            (5, "certified and RANDOM 0.45", "0.45"), (5, "certified and RANDOM 0.45", "30"), (6, "top 0.45", "0.45")]
    df = spark.createDataFrame(rows, "id int, sentence string, literal string")
    values = spark.createDataFrame([("rand_s0", 0.45), ("randomised", 0.99), ("cert", 0.3), (None, 0.7)], "key string, value double")
    names = {"random": ["rand"], "certified": ["cert"], "top": []}
    got = {(r.id, r.literal): r.outcome for r in H.trace_scoped(df, ["id"], "sentence", values, "key", "value", names).collect()}
    elsewhere = "exists elsewhere"
    assert got == {(1, "0.45"): "matched", (2, "0.45"): elsewhere, (3, "0.45"): "matched", (4, "0.99"): elsewhere, (5, "0.45"): "matched", (5, "30"): "matched", (6, "0.45"): elsewhere}


def test_threshold_sweep_against_trying_every_step(spark):
    rng = np.random.default_rng(3)
    rows = [(c, bool(rng.random() < 0.3), float(x)) for c, n in ((1, 400), (2, 30), (3, 5)) for x in np.round(rng.normal(size=n), 2)] + [(4, True, 1.0)]
    best = None
    for c in (1, 2, 3, 4):
        s = np.array([x for k, _, x in rows if k == c])
        y = np.array([b for k, b, _ in rows if k == c])
        for step in range(100):
            tau = s.min() + (s.max() - s.min()) / 100 * step
            tp, wrong = int((y & (s > tau)).sum()), int((y != (s > tau)).sum())
            f1 = 2 * tp / (2 * tp + wrong) if tp else 0.0
            if best is None or f1 > best[3]:
                best = (c, step, tau, f1)
    got = S.tune_threshold(spark.createDataFrame(rows, "layer int, bad boolean, s double"), "bad", "s", ["layer"]).first()
    assert (got.layer, got.step, got.tau, got.f1) == (best[0], best[1], pytest.approx(best[2]), pytest.approx(best[3]))


def test_histogram_of_one_value(spark):
    got = M.group_histogram(spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 2.0)], "g string, s double"), "g", "s").collect()
    assert {(r.g, r.bin, r.n, r.density) for r in got} == {("a", 0, 2, 1.0), ("b", 0, 1, 1.0)}


def test_best_cell_skips_self_scored_and_breaks_ties(spark):
    cells = spark.createDataFrame([("b", "j", 0.2), ("a", "j", 0.2), ("own", "j", 0.1), ("oracle", "j", 0.0)], "arm string, judge string, mean double")
    marked = Rep.mark_self_scored(cells, spark.createDataFrame([("own", "j")], "arm string, judge string"))
    assert Rep.best_per_column(marked, ["oracle"]).first().arm == "a"


def test_frozen_cutoffs_on_a_stream(spark, tmp_path):
    src = spark.range(100).select("id", (F.col("id") % 2 == 0).alias("req"), F.col("id").cast("double").alias("score"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    kept = keep_above(stream, "score", {True: 90.0, False: 95.0}, "req")
    q = kept.writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("kept").collect()) == [90, 92, 94, 95, 96, 97, 98, 99]


def test_frozen_cutoff_reaches_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("double").alias("score")).write.parquet(str(tmp_path / "p"))
    plan = keep_above(spark.read.parquet(str(tmp_path / "p")), "score", 4.0)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(score,4.0)" in plan


def test_stored_decisions_become_a_filter(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0, 1), ("x", 0, 2)], "arm string, seed int, id bigint")
    made = [("x", 0, "a", True, 2.0), ("x", 0, "b", False, None)]
    path = str(tmp_path / "sel")
    W.write_selection(rows, path, spark.createDataFrame(made, "arm string, seed int, g string, certified boolean, tau double"))
    assert spark.read.parquet(path).count() == 2
    new = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, score double")
    got = frozen_filter(new, "score", W.read_decisions(spark, path), "g").collect()
    assert [tuple(r) for r in got] == [("a", 3.0)]


def test_intermediates_leave_nothing(spark):
    import os
    from plumbline.session import intermediates, settle

    with intermediates(spark):
        kept = settle(spark.range(5))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_certificates_of_several_draws_equal_single_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 40)), bool(rng.random() < 0.1), "a" if i % 3 else "b") for i in range(400)]
    pool = spark.createDataFrame(rows, "id int, s double, bad boolean, part string")
    cals = {d: pool.where(F.col("id") % 5 == d) for d in (0, 1)}
    cal = cals[0].withColumn("draw", F.lit(0)).unionByName(cals[1].withColumn("draw", F.lit(1)))
    for strata in ([], ["part"]):
        got = C.certify_draws(pool, cal, "draw", [0, 1, 7], "s", "bad", 0.25, 0.1, strata).toPandas()
        order = [*strata, "q100"]
        for d in (0, 1):
            want = C.certify(pool, cals[d], "s", "bad", 0.25, 0.1, strata).toPandas()
            one = got[got.draw == d].drop(columns="draw").sort_values(order).reset_index(drop=True)
            want = want[one.columns].sort_values(order).reset_index(drop=True)
            assert one.equals(want) and want.passed.any()
        none = got[got.draw == 7]
        assert len(none) == len(got) / 3 and not none.passed.any() and (none.m == 0).all()


def test_rouge_of_hot_prompts_and_empty_texts(spark):
    """One prompt with most of the rows, null and empty texts, and repeated references: as the table has it."""
    rng = np.random.default_rng(7)
    words = lambda: " ".join(rng.choice(list("abcde"), rng.integers(0, 9)))
    gens = [("m", i, "hot" if i < 12 else "cold", words() if i % 5 else None) for i in range(16)]
    refs = [("hot", words()) for _ in range(6)] + [("cold", ""), ("cold", None), ("cold", "a b"), ("cold", "a b")]

    def f1(a, b):
        a, b = (a or "").split(), (b or "").split()
        c = dp_lcs(a, b) if a and b else 0
        return 2 * c / (len(a) + len(b)) if c else 0.0

    want = np.mean([max(f1(h, r) for q, r in refs if q == p) for _, _, p, h in gens])
    got = M.rouge_l(
        spark.createDataFrame(gens, "model string, item int, prompt string, response string"),
        spark.createDataFrame(refs, "prompt string, response string"), "prompt", ["model"], "item",
    ).first()
    assert got.n_prompts == 16 and got.rouge_l == pytest.approx(want)


def test_verdicts_meet_documents_before_they_are_laid_out(spark, tmp_path):
    """Repeated and missing ids join as often as they do after the layout, and the store's size is not taken for its labels'."""
    n = 500
    labels = [(i, i % 2, i % 3 % 2) for i in range(n)] + [(7, 1, 0), (None, 0, 1), (8, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    t = Tables(spark, str(tmp_path))
    items = spark.createDataFrame([(7, "a"), (7, "b"), (8, None), (None, "c"), (9, "a"), (n, "a")], "item_no long, set string")
    late, early = V.verdicts(t).join(items, "item_no"), V.verdicts(t, items)
    assert early.count() == 7 * 72 and early.exceptAll(late.select(*early.columns)).isEmpty()
    size = V.verdicts(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size >= 8 * 72 * n


def test_demo_share_of_an_arm_without_good_rows(spark):
    rows = [("none", 1.0, 0.0), ("none", 1.0, 0.0), ("some", 0.5, 0.25), ("some", 0.0, 0.5), ("null", None, None)]
    got = dict(M.demo_share_good(spark.createDataFrame(rows, "arm string, bad_frac double, demo_share double")).collect())
    assert np.isnan(got["none"]) and got["some"] == 0.5 and got["null"] is None
