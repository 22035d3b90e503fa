"""Operators that learn, by held-out rows and planted cases, and the pipeline by its stages' own brute force."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import ngram_join, quality, secret_scans, toxicity
from tests.llm.test_exact import ODD, components, table

TABLES = os.environ.get("TEST_TABLES_LLM", "/root/testdata/sf0.1")
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@needs_tables
@pytest.mark.parametrize("op,label,n,left_out", [(toxicity.op10, "toxic", 5, 0), (quality.op2, "quality", 4, 2)])
def test_held_out(spark, op, label, n, left_out):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    got = op(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [crc(i, n) == left_out for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = held[held[label] == 1], held[held[label] == 0]
    assert good.predicted.mean() > (0.75 if label == "toxic" else 0.98)
    assert bad.predicted.mean() < (0.01 if label == "toxic" else 0.05)


def learned_rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[5] = w[17] = "scum"
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 0 if bad else 1, int(bad)))
    return rows + [(1000 + k, t, lang) for k, (_, t, lang) in enumerate(ODD)], labels


def test_toxicity_edges(spark):
    rows, labels = learned_rows()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op10(table(spark, rows + [(None, "scum", None)]), marks).collect()}
    assert len(got) == len(rows) + 1 and got[None].held_out is False
    assert np.mean([got[i].score > got[i + 1].score for i in range(0, 400, 4)]) > 0.95
    assert got[1000].score == got[1001].score
    none = spark.createDataFrame([], marks.schema)
    assert {r.score for r in toxicity.op10(table(spark, rows), none).collect()} == {0.5}
    assert toxicity.op10(table(spark, []), marks).collect() == []


def test_quality_edges(spark):
    rows, labels = learned_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op2(table(spark, rows), marks).collect()}
    assert np.mean([got[i].score < got[i + 1].score for i in range(0, 400, 4)]) > 0.95
    assert quality.op2(table(spark, []), marks).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], marks.schema)
    assert all(0 <= r.score <= 1 for r in quality.op2(table(spark, rows), one).collect())
    assert quality.op2(table(spark, rows), spark.createDataFrame([], marks.schema)).count() == len(rows)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [(int(k % 2), np.unique(np.r_[rng.integers(10, 500, 20), 1 + k % 2]).astype(np.int32)) for k in range(300)]
    at, w, ratio, bias, slope, offset = quality.fit_rows(rows, 10)
    full_w, full_r = np.zeros(1024, np.float32), np.zeros(1024, np.float32)
    full_w[at], full_r[at] = w, ratio
    assert all((quality.margin(x, full_r, full_w, bias) > 0) == bool(y) for y, x in rows) and slope > 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    rows = [(int(k % 3 == 0), np.unique(np.r_[rng.integers(10, 60000, 50), 1 + (k % 3 == 0)]).astype(np.int32)) for k in range(600)]
    at, w, bias = toxicity.fit_rows(rows, 16)
    assert 2 in at and len(at) < 200 and w[list(at).index(2)] > 0


def test_markov_tells_random_from_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["tion", "ing", "er", "an", "the", "re", "ou"]) for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(50)) + f" token={rng.getrandbits(160):040x}", "en") for i in range(100)]
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    rows.append((500, f"so {key} and {word()} and 4111111111111111", "en"))
    got = {r.doc_id: r for r in secret_scans.op8(table(spark, rows)).collect()}
    assert got[500].spans == f"random:3:{3 + len(key)}"
    assert all(got[i].n_random == 0 for i in range(100))


def test_pipeline_stages(spark, tmp_path):
    rows, labels = learned_rows()
    rows += [(2000, rows[1][1], "en"), (2001, rows[2][1].replace("a", "a", 1), "en"), (2002, 'keep password = "abc123def" here', "en")]
    folder = str(tmp_path)
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
        if k < 4:
            assert seen[-1].dtypes == docs.dtypes, name
    clean, apart, cut, hidden, packed = (df.toPandas() for df in seen[1:])
    assert 0 < len(clean) < len(rows) and set(range(1, 400, 4)) <= set(clean.doc_id.dropna())
    named = [(int(r.doc_id), r.text, r.lang) for r in clean.itertuples() if r.doc_id == r.doc_id]
    assert set(apart.doc_id.dropna()) == {c for _, _, c in components(named, 3, 90)}
    assert len(cut) == len(apart) and "abc123def" not in "".join(t or "" for t in hidden.text)
    assert 'keep <SECRET>" here' in set(hidden.text)
    assert set(packed.doc_id.dropna()) == set(apart.doc_id.dropna())
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == seen[-1].columns and final.count() == len(packed)


def test_pipeline_links_two_words_replaced(spark):
    words = [f"w{k}" for k in range(100)]
    edited = [f"new{k}" if k in (30, 70) else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_pipeline_on_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_deltas():
    for ids in ([5], [1, 1, 300], [-(2**62), 0, 2**62], [0, 70000]):
        assert ngram_join._undeltas(ngram_join._deltas(np.array(ids, np.int64))).tolist() == ids
