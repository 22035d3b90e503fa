"""Spelling variants by permuterm rotations.

A word with a terminator behind it is written in all its rotations, so that any place
of it stands at the end of one of them. Words that differ in one place then share
everything but that last character, and words that lack it are a rotation of
their own that equals the shared part: after sorting, each such prefix is one range,
and scanning it finds replacements, insertions and deletions of that place at once.

* A ``skip`` row is a rotation without its last character, a letter of the word; a
  ``whole`` row is a rotation with nothing left out.
* Rows with the same key differ in the character left out, so a range has at most
  as many skip rows as there are letters, and one whole row: no range grows with the data.
* Two skip rows of a range are a replacement, found in this range only. A skip and the
  whole row are an insertion; where the character repeats the one before it, the pair
  has been counted at the first of them.

A range gives each of its words the number of words near it there and the best of
them, never a pair for each two. Words are numbered by falling count, then by code points, so
the best is the least number. Rotations of a long word together are as many
characters as its length squared; beyond LONG characters a key is two 64-bit hashes
of the rotation, from prefix sums, and the rows of a word stay linear in its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
TERMINATOR = "$"
LONG = 64
WHOLE = -1
HELD_WORDS, HELD_BYTES = 200_000, 32_000_000  # words that a counting task holds before it hands them on
ROWS = 100_000


def runs_of(doc: int | None, text: str) -> Counter:
    """Lower-cased runs of letters of a text and how often each occurs, with one code point of some of them deleted."""
    out: Counter = Counter()
    salt = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    lower: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        lower[run.encode().lower()] += n  # of bytes, lower() changes A-Z alone
    for run, n in lower.items():
        h = zlib.crc32(run, salt)
        if h % DAMAGE == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points that occur LEAST_COUNT times or more."""

    def work(batches):
        held: Counter = Counter()
        size = 0

        def flush():
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run, n in runs_of(doc, text.as_py() or "").items():
                    if len(run) - run.count(b"\xc3") >= LEAST_LENGTH:  # \xc3 begins every letter that is not ASCII
                        if run not in held:
                            size += len(run)
                        held[run] += n
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _hashed(letters: np.ndarray, width: int) -> np.ndarray:
    """Keys of all windows of ``width`` symbols: a zero byte and two polynomial hashes of the window."""
    n = len(letters) - width + 1
    out = np.zeros((n, 17), np.uint8)
    for k, base in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        value = np.random.default_rng(21 + k).integers(1, 2**63, 0x110000 >> 8, dtype=np.uint64)
        sym = value[letters >> 8] * np.uint64(2 * k + 3) + value[letters & 0xFF] * np.uint64(2 * k + 0x10001)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(letters), np.uint64(base))])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(base, -1, 1 << 64)))])
        sums = np.r_[np.uint64(0), np.cumsum(sym * up[:-1])]
        h = (sums[width:] - sums[:n]) * down
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[:, 1 + 8 * k : 9 + 8 * k] = h.view(np.uint8).reshape(n, 8)
    return out


def rotations(words: DataFrame) -> DataFrame:
    """(key, id, skip, first) for every rotation of every word (id, word)."""
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("skip", pa.int32()), ("first", pa.bool_())])

    def long_word(i: int, word: str):
        m = len(word)
        ring = np.array([*map(ord, word), ord(TERMINATOR), *map(ord, word)], np.int64)
        letters = ring[:m]
        new = np.r_[True, letters[1:] != letters[:-1]]
        for keys, skip, first in (
            (_hashed(ring, m)[1 : m + 1], letters, new),  # windows from 1 on: all but one letter
            (_hashed(ring, m + 1), np.full(m + 1, WHOLE), np.ones(m + 1, bool)),
        ):
            for a in range(0, len(keys), ROWS):
                part = keys[a : a + ROWS]
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(17), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())
                cols = [raw, pa.array(np.full(len(part), i)), pa.array(skip[a : a + ROWS].astype(np.int32)), pa.array(first[a : a + ROWS])]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def work(batches):
        keys, ids, skips, firsts = [], [], [], []
        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = word.as_py()
                m = len(word)
                if m + 1 > LONG:  # as keys of one length must be written alike
                    yield from _mixed(i, word) if m == LONG else long_word(i, word)
                    continue
                ring = f"{word}{TERMINATOR}{word}"
                before = ""
                for k, c in enumerate(word):
                    keys.append(ring[k + 1 : k + 1 + m].encode())
                    skips.append(ord(c))
                    firsts.append(c != before)
                    before = c
                keys += [ring[k : k + m + 1].encode() for k in range(m + 1)]
                skips += [WHOLE] * (m + 1)
                firsts += [True] * (m + 1)
                ids += [i] * (2 * m + 1)
                if len(keys) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((keys, ids, skips, firsts), schema)], schema=schema)
                    keys, ids, skips, firsts = [], [], [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((keys, ids, skips, firsts), schema)], schema=schema)

    def _mixed(i: int, word: str):
        """A word whose keys with one letter left out are text, and whose whole rotations are hashed."""
        m, ring = len(word), f"{word}{TERMINATOR}{word}"
        text = [ring[k + 1 : k + 1 + m].encode() for k in range(m)]
        first = [k == 0 or word[k] != word[k - 1] for k in range(m)]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array([i] * m), pa.array(map(ord, word), pa.int32()), pa.array(first)], schema=schema)
        *_, whole = long_word(i, word)
        yield whole

    return words.select("id", "word").mapInArrow(work, "key binary, id long, skip int, first boolean")


def scan_ranges(key: pa.Array, ids: np.ndarray, skip: np.ndarray, first: np.ndarray):
    """(id, near, best) of the words that have a word near them in the ranges of equal keys of sorted rows."""
    n = len(ids)
    group = np.r_[0, np.cumsum(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))] if n else np.empty(0, np.int64)
    whole = skip == WHOLE
    many = np.bincount(group)[group] > 1
    group, ids, whole, first = group[many], ids[many], whole[many], first[many]
    if not len(ids):
        return ids, ids, ids
    by = np.lexsort((ids, whole, group))
    group, ids, whole, first = group[by], ids[by], whole[by], first[by]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    none = np.iinfo(np.int64).max
    skips = np.bincount(group, weights=~whole, minlength=len(head)).astype(np.int64)
    openings = np.bincount(group, weights=~whole & first, minlength=len(head)).astype(np.int64)
    padded = np.r_[ids, none]
    best = np.where(skips > 0, ids[head], none)
    second = np.where(skips > 1, padded[head + 1], none)
    entire, opener = np.full(len(head), none), np.full(len(head), none)
    entire[group[whole]] = ids[whole]
    np.minimum.at(opener, group[~whole & first], ids[~whole & first])
    has = entire[group] != none
    near = np.where(whole, openings[group], skips[group] - 1 + (first & has))
    other = np.where(ids == best[group], second[group], best[group])
    found = np.where(whole, opener[group], np.where(first, np.minimum(other, entire[group]), other))
    hit = near > 0
    return ids[hit], near[hit], found[hit]


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word) that have words one edit away; best is the least id of them."""

    def scan(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            key = rows.column(0)
            change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))
            edge = int(change[-1]) + 1 if len(change) else 0  # the last range may go on
            held = rows.slice(edge)
            if edge:
                yield ranges(rows.slice(0, edge))
        if held is not None:
            yield ranges(held)

    def ranges(rows):
        ids, skip = (rows.column(k).to_numpy() for k in (1, 2))
        got = scan_ranges(rows.column(0), ids, skip, rows.column(3).to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], ["id", "near", "best"])

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rotations(words).repartition(parts, "key").sortWithinPartitions("key")
    found = placed.mapInArrow(scan, "id long, near long, best long")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least 6 code points and 5 occurrences.

    ``form`` is the most frequent word one edit away (ties: least in code-point order) if it occurs at
    least 5 times as often, else null; ``root`` is the end of the chain of forms. A
    null text has no words, and a row without an id counts as one with an empty id.
    Repeated rows count each on its own; an empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    ranked = count_words(docs).orderBy(F.desc("n"), "word")
    words = settle(ranked.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    form = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = neighbours(words).join(form, "best", "left")
    linked = words.join(near, "id", "left")
    often = F.col("form_n") >= RATIO * F.col("n")
    linked = settle(linked.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(often, F.col(c)).alias(c) for c in ("best", "form", "form_n")],
    ))
    chains = linked.filter("best is not null").select("id", F.col("best").alias("end"))
    most = words.agg(F.max("n")).first()[0] or 0
    reach = 1
    while LEAST_COUNT * RATIO**reach < most:  # a chain that goes on for `reach` forms ends in a word of so many occurrences
        chains = settle(chains)
        ahead = chains.select(F.col("id").alias("end"), F.col("end").alias("beyond"))
        chains = chains.join(ahead, "end", "left").select("id", F.coalesce("beyond", "end").alias("end"))
        reach *= 2
    roots = chains.join(words.select(F.col("id").alias("end"), F.col("word").alias("root")), "end").select("id", "root")
    return linked.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    return variants(docs)
