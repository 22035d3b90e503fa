"""Toxicity scores by logistic regression trained with FTRL-proximal.

Features are hashed word 1-grams, 2-grams and skip-grams (two words with one
between them), each present or not. FTRL-proximal keeps two numbers per
coordinate, which give it its own learning rate, and sets every coordinate with
a small sum to exactly zero (L1), so that of 2**BITS weights only those of telling
words stay: a few kilobytes, broadcast to the tasks that score.

The fit reads a bounded sample of labelled rows (``max_rows``, least hash of the id first),
shuffled as features into one task; labels of all other rows are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import tidy
from plumbline.llm.ngrams import FACTORS, WordHashes, scramble

BITS = 24
MAX_ROWS = 24_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 1.0
TOXIC_WEIGHT = 4.0  # toxic rows are few; each counts so many times
EPOCHS = 6
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(PUNCTUATION).split()


def features(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct hashed 1-grams, 2-grams and skip-grams of word hashes, ascending."""
    up = np.uint64(64 - bits)
    parts = [scramble(words ^ np.uint64(FACTORS[0])) >> up]
    for gap, salt in ((1, FACTORS[1]), (2, FACTORS[2])):
        if len(words) > gap:
            parts.append(scramble(words[:-gap] * np.uint64(FACTORS[3]) + words[gap:] + np.uint64(salt)) >> up)
    return np.unique(np.concatenate(parts)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on binary features; coordinate 2**bits is the constant."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1, np.float32)
        self.n = np.zeros((1 << bits) + 1, np.float32)
        self.bias = 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        limit = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= limit, 0.0, (np.sign(z) * limit - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, x: np.ndarray, label: int) -> float:
        at = np.append(x, self.bias)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p

    def nonzero(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return at.astype(np.int32), self.weights(at).astype(np.float32), float(self.weights(np.array([self.bias]))[0])


def fit_rows(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS):
    """Weights from (label, features) rows, in a fixed pseudo-random order per epoch."""
    model = Ftrl(bits)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(rows[k][1], rows[k][0])
    return model.nonzero()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents, least hash of the id first.

    Rows of labels without an id or label do not count; where an id is labelled more than once the larger label counts.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(picked), "doc_id")  # at most max_rows narrow rows


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % n


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS):
    """(coordinates, weights, constant) from (doc_id, text, label) rows. No rows: no weights, constant 0."""
    schema = pa.schema([("label", pa.int32()), ("order", pa.int64()), ("x", pa.list_(pa.int32()))])

    def featurize(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = [
                (label, doc, features(hashes.of(words_of(text.as_py() or "")), bits))
                for doc, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def fit(batches):
        rows = []
        for batch in batches:
            xs = batch.column(2)
            flat, at = np.asarray(xs.values), np.asarray(xs.offsets)
            rows += [(doc, label, flat[at[i] : at[i + 1]]) for i, (label, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2][:8].tolist()))
        at, w, bias = fit_rows([(label, x) for _, label, x in rows], bits, epochs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w.tolist()], pa.list_(pa.float32())), pa.array([bias])], ["at", "w", "bias"]
        )

    made = sample.mapInArrow(featurize, "label int, order long, x array<int>")
    got = made.repartition(1).mapInArrow(fit, "at array<int>, w array<float>, bias double").first()
    if got is None:
        return np.empty(0, np.int32), np.empty(0, np.float32), 0.0
    return np.array(got["at"], np.int32), np.array(got["w"], np.float32), float(got["bias"])


def score(docs: DataFrame, model, keep: list[str] = (), bits: int = BITS) -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) for every row; the whole text counts, a null text as an empty one."""
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w))

    def work(batches):
        at, w = shared.value  # ascending coordinates
        weighty = np.zeros(1 << bits - 3, np.uint8)  # a bit for each coordinate: most have no weight
        np.bitwise_or.at(weighty, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        hashes = WordHashes()
        for batch in batches:
            scores = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(0)):
                x = features(hashes.of(words_of(text.as_py() or "")), bits)
                x = x[weighty[x >> 3] >> (x & 7).astype(np.uint8) & 1 > 0]
                scores[i] += float(w[np.searchsorted(at, x)].sum(dtype=np.float64))
            p = 1.0 / (1.0 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], [*batch.schema.names[1:], "score"])
        tidy()

    frame = docs.select(F.col("text").alias("_text"), *keep)
    return frame.mapInArrow(work, frame.drop("_text").schema.add("score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on labelled rows whose crc32 remainder by 5 is not 0, and score every row of ``docs``."""
    return score(docs, train(labelled_sample(docs, labels, "toxic", remainder(5) != 0, max_rows)), keep)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; empty and null texts get the score of no features."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity(ids, labels, ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
