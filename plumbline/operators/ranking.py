"""Exact ranks and cut points without a global sort.

A window over a whole pool, or over a stratum that may hold a third of it, puts
all those rows into one task. Everything here reaches the same exact answer in
narrow passes:

1. count rows per value bucket (map-side combined, a few thousand rows out),
   and find by running totals which bucket holds each wanted rank;
2. look inside those few buckets only; one with too many distinct values for a
   task is cut into buckets again.

Equal values are one row after the first aggregation, so ties cost nothing;
where a cut falls inside a group of ties, the group is split by a hash key in
the same two-pass way. Bucket edges are literals in the plan, so retries and
re-evaluations see the same buckets. Cut points are a few rows per stratum and
are pinned (see ``session.pin``), so the pass over the data is a filter.

One rule for odd rows: a row whose value is NULL or NaN has no rank. It is not
counted in the size of its stratum, never kept by a cut, and gets a NULL slot. Sizes
are exact also where hash keys repeat: of the rows that share the boundary's
value and key as many are taken as are wanted, by a hash of the whole row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import ALL
from plumbline.session import pin, settle

BUCKETS = 1024
ROWS_PER_BUCKET = 50_000
MOST = 2_000_000  # distinct values one task orders; larger buckets are cut again
PREFIX = 4  # hex digits: 65,536 buckets of a uniform key
ONE = "_all"

Cuts = DataFrame | Callable[[DataFrame], DataFrame]
Key = str | Column  # a hash key; as an expression it is computed only for rows that need it


def _key(key: Key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def rankable(df: DataFrame, col: str) -> Column:
    """Whether a row has a rank under ``col``: neither NULL nor NaN."""
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) if df.schema[col].dataType.typeName() in ("double", "float") else c.isNotNull()


def with_strata(df: DataFrame, strata: list[str]) -> tuple[DataFrame, list[str]]:
    """The pooled case is one constant stratum."""
    return (df, list(strata)) if strata else (df.withColumn(ONE, F.lit(0)), [ONE])


def drop_one(df: DataFrame) -> DataFrame:
    return df.drop(ONE)


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add a pinned lookup's columns to the rows of its stratum.

    Without strata the lookup is one row, and its values become literals: no
    join at all, and a filter on them reaches the scan.
    """
    if keys != [ONE]:
        return rows.join(lookup, keys, how)
    cols = [f for f in lookup.schema.fields if f.name != ONE]
    row = lookup.first()
    if row is None:
        empty = {f.name: F.lit(None).cast(f.dataType) for f in cols}
        return rows.withColumns(empty) if how == "left" else rows.withColumns(empty).limit(0)
    return rows.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in cols})


def value_edges(df: DataFrame, col: str, buckets: int = BUCKETS, rows_each: int = ROWS_PER_BUCKET) -> list[float]:
    """Distinct approximate quantiles: bucket edges of about equal mass.

    One pass with a mergeable sketch and a count; at most ``buckets`` numbers
    reach the driver, fewer when the rows would fill fewer buckets. The edges
    steer the work only, results never depend on them.
    """
    probs = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    sketch = F.expr(f"percentile_approx(`{col}`, array({probs}), {4 * buckets})")
    found, n = df.where(rankable(df, col)).agg(sketch, F.count(F.lit(1))).first()
    step = max(1, len(found or []) // max(8, n // rows_each))
    picked = (found or [])[step - 1 :: step]
    return sorted({float(v) for v in picked if v == v and abs(v) != float("inf")}) or [0.0]


def bucketed(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol="_b").transform(df)


def cuts_of(*cuts: tuple[int, str]) -> Callable[[DataFrame], DataFrame]:
    """Cuts as SQL over the stratum size, e.g. ``(0, "n_total div 2")``."""
    rows = ", ".join(f"struct({c} AS cut, CAST({rank} AS BIGINT) AS rank)" for c, rank in cuts)

    def make(totals: DataFrame) -> DataFrame:
        keys = [f"`{c}`" for c in totals.columns]
        return totals.selectExpr(*keys, f"inline(array({rows}))")

    return make


def _want(cuts: Cuts, counts: DataFrame, strata: list[str]) -> DataFrame:
    if not callable(cuts):
        return cuts
    return cuts(counts.groupBy(*strata).agg(F.sum("_n").alias("n_total")))


def _running(counts: DataFrame, part: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order)
    hi = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_n"))


def _inside(rank: str) -> Column:
    return (F.col(rank) > F.col("_lo")) & (F.col(rank) <= F.col("_hi"))


def _count() -> Column:
    return F.count(F.lit(1)).alias("_n")


def _cut_again(
    values: DataFrame, hit: DataFrame, keys: list[str], col: str, most: int, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Part the buckets with more than ``most`` distinct values until none is left.

    Edges are quantiles of a bucket's distinct values, not of its rows, so ties
    cannot keep a bucket whole. Only the parts that hold a wanted rank go on to the next level.
    """
    on = [*keys, "_b"]
    path = F.col("_b").cast("string")
    values, hit = settle(values.withColumn("_b", path)), pin(hit.withColumn("_b", path))
    probs = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    sketch = F.expr(f"percentile_approx(`{col}`, array({probs}), {4 * buckets})").alias("_edges")
    while True:
        sizes = values.groupBy(*on).agg(F.count(F.lit(1)).alias("_distinct"), sketch)
        big = pin(sizes.where(F.col("_distinct") > most).drop("_distinct"))
        if big.isEmpty():
            return values, hit
        place = F.size(F.filter("_edges", lambda e: e < F.col(col)))
        parts = values.join(big, on).withColumn("_part", place).drop("_edges")
        counts = _running(parts.groupBy(*on, "_part").agg(F.sum("_n").alias("_n")), on, "_part")
        deeper = F.concat_ws("/", "_b", F.col("_part").cast("string"))
        moved = (
            counts.join(hit, on)
            .where((F.col("rank") - F.col("_base") > F.col("_lo")) & (F.col("rank") - F.col("_base") <= F.col("_hi")))
            .withColumn("_base", F.col("_base") + F.col("_lo"))
            .withColumn("_b", deeper)
            .select(*hit.columns)
        )
        still = hit.join(big.select(*on), on, "left_anti").select(*hit.columns)
        moved = pin(moved)
        inner = parts.withColumn("_b", deeper).join(moved.select(*on).distinct(), on, "left_semi").select(*values.columns)
        values = settle(values.join(big.select(*on), on, "left_anti").select(*values.columns).unionByName(inner))
        hit = pin(still.unionByName(moved))


def value_cuts(
    df: DataFrame,
    col: str,
    cuts: Cuts,
    strata: list[str] | None = None,
    edges: list[float] | None = None,
    most: int = MOST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The value at each wanted rank (1 = smallest).

    ``cuts``: (strata, cut, rank), or a function of the per-stratum totals.
    Returns (strata, cut, rank, value, below, ties): rows strictly below the
    value, and rows equal to it. Ranks outside 1..n give no row; further
    columns of ``cuts`` are passed on. A bucket with more than ``most`` distinct
    values is cut into ``buckets`` parts again, whatever the number of levels.
    """
    strata = strata or []
    slim, keys = with_strata(df.select(*strata, col).where(rankable(df, col)), strata)
    rows = bucketed(slim, col, edges or value_edges(slim, col))
    counts = rows.groupBy(*keys, "_b").agg(_count())
    want = _want(cuts if callable(cuts) or strata else cuts.withColumn(ONE, F.lit(0)), counts, keys)
    extra = [c for c in want.columns if c not in (*keys, "cut", "rank")]
    hit = pin(
        _running(counts, keys, "_b")
        .join(want, keys)
        .where(_inside("rank"))
        .select(*keys, "_b", "cut", "rank", *extra, F.col("_lo").alias("_base"), F.col("_n").alias("_rows"))
    )
    values = (
        rows.join(hit.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
        .groupBy(*keys, "_b", col)
        .agg(_count())
    )
    large = not hit.where(F.col("_rows") > most).isEmpty()
    hit = hit.drop("_rows")
    if large:
        values, hit = _cut_again(values, hit, keys, col, most, buckets)
    found = (
        _running(values, [*keys, "_b"], col)
        .join(hit.withColumn("_r", F.col("rank") - F.col("_base")), [*keys, "_b"])
        .where(_inside("_r"))
        .select(
            *keys,
            "cut",
            "rank",
            *extra,
            F.col(col).alias("value"),
            (F.col("_base") + F.col("_lo")).alias("below"),
            F.col("_n").alias("ties"),
        )
    )
    return pin(found if strata else drop_one(found))


def _keys_at(rows: DataFrame, want: DataFrame | Callable, part: list[str]) -> DataFrame:
    """The hash key ``_k`` at each wanted rank: (part, cut, rank, _k, take, same), pinned.

    Keys are uniform, so their leading hex digits are an even histogram. ``same``
    rows share the key and ``take`` of them belong to the wanted ranks.
    """
    rows = rows.where("_k is not null").withColumn("_h", F.substring("_k", 1, PREFIX))
    counts = rows.groupBy(*part, "_h").agg(_count())
    want = _want(want, counts, part)
    by = list(dict.fromkeys([*part, "cut"]))
    hit = pin(
        _running(counts, part, "_h")
        .join(want, part)
        .where(_inside("rank"))
        .select(*by, "rank", "_h", (F.col("rank") - F.col("_lo")).alias("_r"))
    )
    keys = rows.join(hit.select(*part, "_h").distinct(), [*part, "_h"], "left_semi").groupBy(*part, "_h", "_k").agg(_count())
    return pin(
        _running(keys, [*part, "_h"], "_k")
        .join(hit, [*part, "_h"])
        .where(_inside("_r"))
        .select(*by, "rank", "_k", (F.col("_r") - F.col("_lo")).alias("take"), F.col("_n").alias("same"))
    )


def _boundary(col: str, nothing, everything) -> Column:
    return F.when(F.col("rank") < 1, F.lit(nothing)).otherwise(F.coalesce(col, F.lit(everything)))


def key_cuts(df: DataFrame, key: Key, cuts: Cuts, strata: list[str] | None = None) -> DataFrame:
    """The hash key at each wanted rank: (strata, cut, rank, key, take, same).

    Ranks past the end give the key that keeps everything, ranks below 1 the
    empty key that keeps nothing.
    """
    strata = strata or []
    rows, keys = with_strata(df.select(*strata, _key(key).alias("_k")), strata)
    if callable(cuts):
        want = pin(cuts(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))))
    else:
        want = cuts if strata else cuts.withColumn(ONE, F.lit(0))
    found = _keys_at(rows, want, keys).drop("rank")
    out = want.join(found, [*keys, "cut"], "left").select(
        *keys, "cut", "rank", _boundary("_k", "", ALL).alias("key"), "take", "same"
    )
    return pin(out if strata else drop_one(out))


def rank_cuts(
    df: DataFrame,
    order: str,
    key: Key,
    cuts: Cuts,
    strata: list[str] | None = None,
    edges: list[float] | None = None,
) -> DataFrame:
    """Boundaries of rank intervals under the order (``order``, ``key``) ascending.

    Returns (strata, cut, rank, value, key, take, same): a row lies at or before the cut when
    (order, key) <= (value, key); of the ``same`` rows that equal the boundary ``take`` do.
    Keys are computed for the rows of split ties only.
    """
    strata = strata or []
    rows, keys = with_strata(df.where(rankable(df, order)), strata)
    if callable(cuts):
        want = pin(cuts(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))))
    else:
        want = cuts if strata else cuts.withColumn(ONE, F.lit(0))
    at = value_cuts(rows, order, want.select(*keys, "cut", "rank"), keys, edges)
    part = [*keys, order]
    split = at.where("rank - below < ties").select(
        *keys, F.col("value").alias(order), "cut", F.expr("rank - below").alias("rank")
    )
    none = F.lit(None).cast("bigint")
    by_key = at.select(*keys, "cut", F.lit(None).cast("string").alias("_k"), none.alias("take"), none.alias("same")).limit(0)
    if not split.isEmpty():
        groups = split.select(*part).distinct()
        tied = rows.join(groups, part, "left_semi").select(*part, _key(key).alias("_k"))
        by_key = _keys_at(tied, split, part).select(*keys, "cut", "_k", "take", "same")
    on = [*keys, "cut"]
    out = (
        want.select(*on, "rank")
        .join(at.select(*on, "value"), on, "left")
        .join(by_key, on, "left")
        .select(
            *on,
            "rank",
            _boundary("value", float("-inf"), float("inf")).alias("value"),
            _boundary("_k", "", ALL).alias("key"),
            "take",
            "same",
        )
    )
    return pin(out if strata else drop_one(out))


def _parted(bounds: DataFrame) -> DataFrame:
    """Boundaries inside a group of rows with one value and key."""
    return bounds.where("take < same")


def _numbered_at(rows: DataFrame, at: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_rn``: a row's number among those equal to a boundary in ``at`` (by a hash of the row), 0 elsewhere."""
    marks = at.select(*on).distinct()
    w = Window.partitionBy(*on).orderBy(F.xxhash64(*[c for c in rows.columns]))
    same = rows.join(marks, on, "left_semi").withColumn("_rn", F.row_number().over(w))
    return rows.join(marks, on, "left_anti").withColumn("_rn", F.lit(0)).unionByName(same)


def _with_boundary(rows: DataFrame, bounds: DataFrame, order: str | None, key: Key, keys: list[str], how: str):
    parted = _parted(bounds)
    rn = F.lit(0)
    if not parted.isEmpty():
        on = [*keys, *([order] if order else []), "_key"]
        at = parted.withColumn("_key", F.col("key"))
        rows = _numbered_at(rows.withColumn("_key", _key(key)), at.withColumn(order, F.col("value")) if order else at, on)
        key, rn = "_key", F.col("_rn")
    cols = [F.col("key").alias("_bk"), F.col("take").alias("_take")] + ([F.col("value").alias("_bv")] if order else [])
    joined = attach(rows, bounds.select(*keys, *cols), keys, how)
    within = (_key(key) < F.col("_bk")) | ((_key(key) == F.col("_bk")) & (rn <= F.coalesce("_take", F.lit(0).cast("bigint"))))
    if order:
        within = (F.col(order) < F.col("_bv")) | ((F.col(order) == F.col("_bv")) & within)
    return joined, within


EDGES = ("_bk", "_bv", "_take", "_rn", "_key")


def keep_through(
    df: DataFrame, bounds: DataFrame, order: str | None, key: Key, strata: list[str] | None = None
) -> DataFrame:
    """Rows at or before their stratum's boundary; a narrow pass over ``df``.

    Strata without a boundary keep nothing.
    """
    rows, keys = with_strata(df, strata or [])
    edge = bounds if strata else bounds.withColumn(ONE, F.lit(0))
    joined, within = _with_boundary(rows, edge, order, key, keys, "inner")
    out = joined.where(within).drop(*EDGES)
    return out if strata else drop_one(out)


def mark_through(
    df: DataFrame, bounds: DataFrame, order: str | None, key: Key, strata: list[str] | None = None
) -> DataFrame:
    """Like ``keep_through``, but keeps every row and marks the kept ones ``within``."""
    rows, keys = with_strata(df, strata or [])
    edge = bounds if strata else bounds.withColumn(ONE, F.lit(0))
    joined, within = _with_boundary(rows, edge, order, key, keys, "left")
    out = joined.withColumn("within", F.coalesce(within, F.lit(False))).drop(*EDGES)
    return out if strata else drop_one(out)


def rank_slots(
    df: DataFrame, bounds: DataFrame, order: str, key: Key, cuts: list[int], strata: list[str] | None = None
) -> DataFrame:
    """Add ``slot``: how many of the stratum's boundaries ``cuts`` the row lies beyond; NULL for rows without a rank.

    The boundaries become columns, so the count is plain generated arithmetic.
    """
    rows, keys = with_strata(df, strata or [])
    edge = bounds if strata else bounds.withColumn(ONE, F.lit(0))
    parted = _parted(edge)
    rn = F.lit(0)
    if not parted.isEmpty():
        at = parted.withColumn("_key", F.col("key")).withColumn(order, F.col("value"))
        rows = _numbered_at(rows.withColumn("_key", _key(key)), at, [*keys, order, "_key"])
        key, rn = "_key", F.col("_rn")
    wide = pin(
        edge.groupBy(*keys).agg(
            *[F.max(F.when(F.col("cut") == c, F.col(x))).alias(f"_{x}{c}") for c in cuts for x in ("value", "key", "take")]
        )
    )
    slot = F.lit(0)
    for c in cuts:
        v, k, take = F.col(f"_value{c}"), F.col(f"_key{c}"), F.coalesce(f"_take{c}", F.lit(0).cast("bigint"))
        beyond = (F.col(order) > v) | ((F.col(order) == v) & ((_key(key) > k) | ((_key(key) == k) & (rn > take))))
        slot = slot + F.when(beyond, 1).otherwise(0)
    out = (
        attach(rows, wide, keys, "left")
        .withColumn("slot", F.when(rankable(df, order), slot))
        .drop(*[f"_{x}{c}" for c in cuts for x in ("value", "key", "take")], *EDGES)
    )
    return out if strata else drop_one(out)


def lowest(df: DataFrame, order: str | None, key: Key, n: int) -> DataFrame:
    """The ``n`` first rows under (order, key), exactly; all ranked rows when there are fewer.

    Two narrow counting passes find the boundary and a filter keeps the rows, so nothing is sorted whole.
    """
    return first_ranks(df, order, key, cuts_of((0, str(int(n)))))


def first_ranks(
    df: DataFrame, order: str | None, key: Key, quotas: Cuts, strata: list[str] | None = None
) -> DataFrame:
    """The first rows of every stratum, as many as its quota says.

    ``quotas``: (strata, cut, rank) with one cut per stratum, or a function of
    the per-stratum totals. Strata without a quota keep nothing.
    """
    if order:
        bounds = rank_cuts(df, order, key, quotas, strata)
    else:
        bounds = key_cuts(df, key, quotas, strata)
    return keep_through(df, bounds, order, key, strata)


def with_position(df: DataFrame, key: Column, out: str) -> DataFrame:
    """Add ``out``: the 0-based place of the row in the order of a hash key (equal keys: by a hash of the row).

    Leading digits of the key are an even histogram: their running counts give each
    group's first place, and a window numbers the rows of one group.
    """
    cols = df.columns
    rows = df.withColumn("_k", key).withColumn("_h", F.substring("_k", 1, PREFIX))
    counts = _running(rows.groupBy("_h").agg(_count()).withColumn(ONE, F.lit(0)), [ONE], "_h").select("_h", "_lo")
    w = Window.partitionBy("_h").orderBy("_k", F.xxhash64(*cols))
    return rows.join(counts, "_h").select(*cols, (F.col("_lo") + F.row_number().over(w) - 1).alias(out))


def value_curve(
    df: DataFrame,
    col: str,
    measures: dict[str, Column],
    strata: list[str] | None = None,
    edges: list[float] | None = None,
) -> DataFrame:
    """Running totals over the distinct values of ``col``, ascending.

    ``measures`` are summed columns. Returns one row per (strata, value) with
    each measure, ``below_<measure>`` (strictly smaller values) and
    ``total_<measure>``. Rows are combined per value before the one shuffle of
    the source, the distinct values are stored, and the running sums go bucket
    by bucket.
    """
    df, keys = with_strata(df, strata or [])
    names = list(measures)
    per_value = settle(df.groupBy(*keys, col).agg(*[F.sum(measures[m]).alias(m) for m in names]))
    rows = bucketed(per_value, col, edges or value_edges(per_value, col))
    heads = rows.groupBy(*keys, "_b").agg(*[F.sum(m).alias(m) for m in names])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy(*keys)
    heads = pin(
        heads.select(
            *keys,
            "_b",
            *[(F.sum(m).over(wb) - F.col(m)).alias(f"_base_{m}") for m in names],
            *[F.sum(m).over(wt).alias(f"total_{m}") for m in names],
        )
    )
    wv = Window.partitionBy(*keys, "_b").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(heads, [*keys, "_b"]).select(
        *keys,
        col,
        *names,
        *[(F.col(f"_base_{m}") + F.sum(m).over(wv) - F.col(m)).alias(f"below_{m}") for m in names],
        *[f"total_{m}" for m in names],
    )
    return out if strata else drop_one(out)

