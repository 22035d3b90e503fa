"""Secret scans: fixed patterns, and strings that look more random than any identifier.

Two character Markov models are trained from samples labelled by the patterns
themselves: the values that the patterns find are random strings, all other long tokens of
the corpus are ordinary ones. Every document counts. A long token is a secret if
the log-likelihood ratio of its characters, random against ordinary, reaches
``ODDS``. The added spans never overlap the patterns' own: a token that these cut is
scored in the parts they leave.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.batches import text_chunks

# Fixed patterns and least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
NAMES = r"password|passwd|secret|token|api_?key"
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0 stands between tokens
LONG, TRAIN_LONG = 16, 6
ODDS = 18.0
UNIFORM = 0.2
RARE = 1000.0  # pairs that a character needs before its own successors outweigh the corpus's: a few odd strings teach nothing
MARK = "<SECRET>"


def _either_case(names: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", names)


ASSIGN = re.compile(rf"""(?:{_either_case(NAMES)})["']?\x20*[:=]\x20*["']?({VALUE})""")
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LONG},}}")
TRAIN_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{TRAIN_LONG},}}")


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in order of start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), *m.span(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def _codes() -> np.ndarray:
    codes = np.zeros(256, np.int64)
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i + 1
    return codes


def pair_counts(tokens: list[str]) -> np.ndarray:
    """How often each character follows each other one (0: before or after a token)."""
    flat = _codes()[np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode("ascii", "replace"), np.uint8)]
    return np.bincount(flat[:-1] * STATES + flat[1:], minlength=STATES * STATES)


def split_tokens(text: str) -> tuple[list[str], list[str]]:
    """Values that the patterns find, and all other tokens long enough to train on."""
    spans = base_spans(text)
    if not spans:
        return [], TRAIN_TOKEN.findall(text)
    found = [text[a:b] for _, _, _, a, b in spans]
    rest, at = [], 0
    for start, _, end, _, _ in spans:
        rest += TRAIN_TOKEN.findall(text[at : max(at, start)])
        at = max(at, end)
    return [t for v in found for t in re.findall(r"[A-Za-z0-9+/_=-]+", v)], rest + TRAIN_TOKEN.findall(text[at:])


@dataclass
class Markov:
    """Log-likelihood ratio, random against ordinary, of each pair of characters."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        code = _CODES[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[0, code[0]] + self.ratio[code[:-1], code[1:]].sum())


_CODES = _codes()


def markov(random: np.ndarray, ordinary: np.ndarray) -> Markov:
    """From pair counts of both samples; the random model is mixed with even chances, both are smoothed."""

    def model(counts: np.ndarray, even: float, weight: float) -> np.ndarray:
        c = counts.reshape(STATES, STATES)[:, 1:].astype(float)
        backed = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * c.shape[1])  # the next character whatever the last
        p = (c + weight * backed) / (c.sum(axis=1, keepdims=True) + weight)
        return (1 - even) * p + even / c.shape[1]

    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = np.log(model(random, UNIFORM, 20.0)) - np.log(model(ordinary, 1e-3, RARE))
    return Markov(ratio)


def train(docs: DataFrame) -> Markov:
    """Models from all documents; only the two count matrices reach the driver. No documents: all ratios come from smoothing."""

    def count(batches):
        total = np.zeros((2, STATES * STATES), np.int64)
        for _, texts in text_chunks(batches):
            found, rest = [], []
            for t in texts:
                a, b = split_tokens(t)
                found += a
                rest += b
            total[0] += pair_counts(found)
            total[1] += pair_counts(rest)
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[kind, pair])], ["kind", "pair", "n"])

    rows = docs.select(F.lit(0).alias("i"), "text").mapInArrow(count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((2, STATES * STATES), np.int64)
    for r in rows:  # at most 2 * STATES**2
        total[r.kind, r.pair] = r.n
    return markov(total[0], total[1])


def find_spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans and of the model's, in order of start, then kind.

    A token that the patterns' spans cut is scored in the parts that they leave.
    """
    base = base_spans(text)
    spans = [(s, k, e) for s, k, e, _, _ in base]
    k = 0
    for m in TOKEN.finditer(text):
        at, stop = m.span()
        while k < len(base) and base[k][2] <= at:
            k += 1
        j = k
        while at < stop:
            while j < len(base) and base[j][2] <= at:
                j += 1
            upto = min(stop, max(at, base[j][0])) if j < len(base) else stop
            part = text[at:upto]
            if len(part) >= LONG and not part.isdigit() and model.score(part) >= ODDS:  # a number is no secret
                spans.append((at, 3, upto))
            at = stop if j >= len(base) or base[j][0] >= stop else max(at, base[j][2])
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of spans replaced by one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, keep: list[str], model: Markov | None = None) -> DataFrame:
    """The columns ``keep``, ``spans`` (kind, start, end in code points, end exclusive) and ``redacted`` text of every row.

    Null and empty texts have no spans. Repeated rows give repeated rows; an
    empty table gives none. ``keep`` may not hold the two new names.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    frame = docs.select(F.col("text").alias("_text"), *keep)
    out = frame.drop("_text").schema.add("spans", SPANS).add("redacted", "string")

    def work(batches):
        found = Markov(shared.value)
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(0):
                t = text.as_py()
                got = find_spans(t, found) if t else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in got])
                texts.append(redact(t, got) if got else t)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(spans, pa.list_(SPAN)), pa.array(texts, pa.string())], [*batch.schema.names[1:], "spans", "redacted"]
            )

    return frame.mapInArrow(work, out)


def op8(docs: DataFrame) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scan(ids, ["doc_id"]).select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("random"),
    )
