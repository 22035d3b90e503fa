"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

A row number x < N is written as (x div b, x mod b) with a*b >= N and a, b near
the root of N. Rounds add to one half, modulo its own size, a keyed function of
the other half; each round can be undone, so all rounds together permute
0..a*b-1. A result beyond N is permuted again until it is below N (cycle
walking), which permutes 0..N-1. Shard and slot are the remainder and quotient
of the permuted number, so shard sizes differ by one row at most, and the place
of any row, or the row at any place, is computed from (N, seed) alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.order import number_rows, order_key

PRIME = 2**31 - 1
ROUNDS = 8
WALK = 12


def _constants(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round, from the seed by a multiplicative generator."""
    x, out = (seed * 2654435761 + 97) % PRIME or 1, []
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
    return a, -(-n // a)


def _mix(half, c):
    """A keyed function of a half; all products stay below 2**62 (plain ints or columns)."""
    x = (half % PRIME + c[0]) % PRIME
    x = (x * x + c[1]) % PRIME
    return (x * x + x * c[2] % PRIME) % PRIME


def _once(x: Column, n: int, seed: int) -> Column:
    """One pass of all rounds. The pair of halves is folded over the rounds, so nothing is evaluated twice."""
    a, b = _sides(n)
    rounds = F.array(*[F.array(*[F.lit(v).cast("long") for v in c], F.lit(i % 2).cast("long")) for i, c in enumerate(_constants(seed))])

    def turn(acc: Column, c: Column) -> Column:
        key = [c[0], c[1], c[2]]
        left, right = acc["l"], acc["r"]
        return F.when(
            c[3] == 0, F.struct(((left + _mix(right, key)) % F.lit(a)).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), ((right + _mix(left, key)) % F.lit(b)).alias("r")))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    if n >= 2**50:  # beyond doubles' exact range
        start = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    return F.aggregate(rounds, start, turn, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` in the shuffle of ``n`` rows."""
    a, b = _sides(n)
    spare = a * b - n

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), start,
            lambda v, _: F.when(v < n, v).otherwise(_once(v, n, seed)),
        )

    got = _once(x, n, seed)
    if not spare:
        return got
    # A walk meets each of the spare numbers at most once; beyond WALK steps (for a
    # large n less than one row in 10**20) the full length is walked.
    return F.aggregate(
        F.array(got), F.lit(0).cast("long"),
        lambda _, first: F.when(first < n, first).otherwise(
            F.aggregate(
                F.array(walk(first, min(WALK, spare))), F.lit(0).cast("long"),
                lambda _, v: F.when(v < n, v).otherwise(walk(v, spare)),
            )
        ),
    )


def place(x: int, n: int, seed: int = 0) -> int:
    """``permute`` of one number, in plain Python."""
    a, b = _sides(n)
    while True:
        left, right = divmod(x, b)
        for i, c in enumerate(_constants(seed)):
            if i % 2 == 0:
                left = (left + _mix(right, c)) % a
            else:
                right = (right + _mix(left, c)) % b
        x = left * b + right
        if x < n:
            return x


def row_at(place: int, n: int, seed: int = 0) -> int:
    """The row number at a place: the rounds undone."""
    a, b = _sides(n)
    while True:
        left, right = divmod(place, b)
        for i, c in reversed(list(enumerate(_constants(seed)))):
            if i % 2 == 0:
                left = (left - _mix(right, c)) % a
            else:
                right = (right - _mix(left, c)) % b
        place = left * b + right
        if place < n:
            return place


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row of ``docs``.

    Rows are numbered by (doc_id, text hash, size, crc); rows without an id come first, and
    rows equal in all of these are interchangeable. A null text has size 16 and
    the crc of no bytes. An empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        order_key().alias("_key"),
        F.xxhash64(raw).alias("_tie"),
        (F.octet_length(raw).cast("long") + 16).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(base, "_key", ["_tie", "size", "text_crc32"], "row_number")
    at = numbered.withColumn("_at", permute(F.col("row_number"), max(n, 1), seed))
    return at.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.expr(f"_at div {shards}").alias("slot"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return shard_documents(docs, shards=40, seed=7).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
