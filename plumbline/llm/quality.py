"""Quality scores by naive Bayes support vectors.

A document's features are the n-grams it has: word 1-grams and 2-grams, and
1-grams to 3-grams of word shapes (letter case, digits, symbols at the end, and whether
the word repeats the one before). Each indicator is scaled by its class log-count
ratio r, and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent; the weights are then drawn towards their mean size, as between
the support vectors and naive Bayes. A logistic curve over margins of rows the
fit has not seen gives scores from 0 to 1.

The fit reads a bounded sample of labelled rows (``max_rows``) in one task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ngrams import FACTORS, WordHashes, scramble
from plumbline.llm.toxicity import labelled_sample, remainder

BITS = 20
MAX_ROWS = 16_000
SMOOTH = 1.0
COST = 1.0
BALANCE = 0.5
EPOCHS = 15


def _shape(word: bytes) -> int:
    """A small number for the look of a word: its case, digits, non-ASCII letters, and what it ends with."""
    last = word[-1:]
    if not word.isascii():
        kind = 4 if word[0] >= 0x80 else 5
    elif word.isdigit():
        kind = 6
    elif not any(97 <= c <= 122 or 65 <= c <= 90 for c in word):
        kind = 7 + min(len(word), 3)
    elif word.upper() == word:
        kind = 1 if len(word) > 1 else 2
    else:
        kind = 3 if word[:1].isupper() else 0
    if last.isalnum() or word[-1] >= 0x80:
        end = 0
    elif last in b".,;":
        end = 1
    else:
        end = 2 + min(len(word) - len(word.rstrip(b"!?#*$%&|<>=+~@^")), 3)
    return kind * 8 + end


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        s = self[word] = _shape(word)
        return s


def features(text: str, hashes: WordHashes, shapes: Shapes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, ascending."""
    words = text.encode("utf-8", "surrogatepass").split()
    up = np.uint64(64 - bits)
    if not words:
        return np.empty(0, np.int32)
    w = hashes.of(words)
    shape = np.fromiter(map(shapes.__getitem__, words), np.uint64, len(words))
    shape[1:] += np.uint64(128) * (w[1:] == w[:-1])
    parts = [scramble(w ^ np.uint64(FACTORS[0])) >> up, scramble(w[:-1] * np.uint64(FACTORS[1]) + w[1:]) >> up]
    for n in (1, 2, 3):
        h = np.full(max(0, len(words) - n + 1), np.uint64(n))
        for i in range(n):
            h = scramble(h * np.uint64(FACTORS[2]) + shape[i : len(words) - n + 1 + i])
        parts.append(h >> up)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def log_count_ratios(rows: list[tuple[int, np.ndarray]], bits: int = BITS, smooth: float = SMOOTH) -> np.ndarray:
    counts = np.full((2, 1 << bits), smooth)
    for label, x in rows:
        counts[label, x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0]).astype(np.float32)


def dual_descent(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS):
    """Hinge-loss weights (and constant) over indicators scaled by ``ratio``; rows are scaled to unit length."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = []
    for label, x in rows:
        v = ratio[x].astype(np.float64)
        norm = np.sqrt(v @ v)
        values.append((1.0 if label else -1.0, x, v / norm if norm else v))
    bad = sum(1 for y, _, _ in values if y < 0)
    weight = {1.0: cost * len(values) / max(1, 2 * (len(values) - bad)), -1.0: cost * len(values) / max(1, 2 * bad)}
    alpha = np.zeros(len(values))
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(values)):
            y, x, v = values[k]
            gradient = y * (w[x] @ v + bias) - 1.0
            old = alpha[k]
            new = min(max(old - gradient / (v @ v + 1.0), 0.0), weight[y])
            if new != old:
                alpha[k] = new
                step = (new - old) * y
                w[x] += step * v
                bias += step
    return w, bias


def interpolate(w: np.ndarray, balance: float = BALANCE) -> np.ndarray:
    used = np.abs(w) > 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return (1 - balance) * np.sign(w) * mean * used + balance * w


def margin(x: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    v = ratio[x]
    norm = float(np.sqrt(v @ v))
    return (float(w[x] @ v) / norm if norm else 0.0) + bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve through (margin, label), by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    up, down = (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2)
    target = np.where(labels > 0, up, down)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, s = target - p, p * (1 - p) + 1e-9
        g = np.array([d @ margins - 1e-3 * a, d.sum()])
        h = np.array([[s @ (margins * margins) + 1e-3, s @ margins], [s @ margins, s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(rows: list[tuple[int, np.ndarray]], bits: int = BITS):
    """(coordinates, scaled weights, ratios, constant, slope, offset); the curve comes from a fifth that a first fit leaves out."""
    labels = {label for label, _ in rows}
    if len(labels) < 2:
        always = 1.0 if labels == {1} else -1.0 if labels == {0} else 0.0
        return np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32), always, 3.0, 0.0
    aside, inner = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    slope, offset = 1.0, 0.0
    if len({label for label, _ in aside}) == 2 and len({label for label, _ in inner}) == 2:
        ratio = log_count_ratios(inner, bits)
        w, bias = dual_descent(inner, ratio)
        w = interpolate(w)
        got = np.array([margin(x, ratio, w, bias) for _, x in aside])
        slope, offset = logistic(got, np.array([label for label, _ in aside], float))
    ratio = log_count_ratios(rows, bits)
    w, bias = dual_descent(rows, ratio)
    w = interpolate(w)
    at = np.flatnonzero((w != 0) | (np.abs(ratio - np.median(ratio)) > 1e-6)).astype(np.int32)
    return at, w[at].astype(np.float32), ratio[at], bias, slope, offset


def train(sample: DataFrame, bits: int = BITS):
    schema = pa.schema([("label", pa.int32()), ("order", pa.int64()), ("x", pa.list_(pa.int32()))])

    def featurize(batches):
        hashes, shapes = WordHashes(), Shapes()
        for batch in batches:
            rows = [
                (label, doc, features(text.as_py() or "", hashes, shapes, bits))
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
        rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1], len(r[2]), r[2][:8].tolist()))
        at, w, ratio, bias, slope, offset = fit_rows([(label, x) for _, label, x in rows], bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([ratio.tobytes()]), *(pa.array([float(v)]) for v in (bias, slope, offset))],
            ["at", "w", "ratio", "bias", "slope", "offset"],
        )

    made = sample.mapInArrow(featurize, "label int, order long, x array<int>")
    got = made.repartition(1).mapInArrow(fit, "at binary, w binary, ratio binary, bias double, slope double, offset double").first()
    if got is None:
        return fit_rows([], bits)
    return (
        np.frombuffer(got["at"], np.int32), np.frombuffer(got["w"], np.float32), np.frombuffer(got["ratio"], np.float32),
        got["bias"], got["slope"], got["offset"],
    )


def score(docs: DataFrame, model, keep: list[str] = (), bits: int = BITS) -> DataFrame:
    """The columns ``keep`` and ``score`` for every row; the whole text counts, a null text as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        at, w, ratio, bias, slope, offset = shared.value
        weights, ratios = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        weights[at], ratios[at] = w, ratio
        hashes, shapes = WordHashes(), Shapes()
        for batch in batches:
            got = np.array([margin(features(t.as_py() or "", hashes, shapes, bits), ratios, weights, bias) for t in batch.column(0)])
            p = 1 / (1 + np.exp(-np.clip(slope * got + offset, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64())], [*batch.schema.names[1:], "score"])

    frame = docs.select(F.col("text").alias("_text"), *keep)
    return frame.mapInArrow(work, frame.drop("_text").schema.add("score", "double"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; an empty or null text gets the score of no features."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(labelled_sample(ids, labels, "quality", remainder(4) != 2, MAX_ROWS))
    return score(ids, model, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
