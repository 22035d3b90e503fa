"""Global order without a global sort: exact key cuts, so one range of keys is one window.

A window over a whole table is one task. Here a quantile sketch over the key
column names cut values that occur in the table; a row's piece is the number of
cuts at or below its key, and windows run inside pieces. Only the cuts and one
count per piece reach the driver; their number is a parameter, not the data's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_KEY = -(2**63)  # rows without an id come first, in the order of their texts


def order_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_KEY).cast("long"))


def pieces_for(df: DataFrame) -> int:
    """Four pieces per shuffle partition, so that hashing them leaves no task with many."""
    return min(4000, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_cuts(df: DataFrame, key: str, pieces: int | None = None) -> list[int]:
    """Ascending key values of ``df``, the smallest first, that cut it into about equal pieces."""
    n = pieces or pieces_for(df)
    at = [i / n for i in range(n)]
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, at, 20 * n).alias("cuts")).first()
    return [] if row.lo is None else sorted({row.lo, *row.cuts})


def piece_of(key: Column, cuts: list[int]) -> Column:
    """0-based piece of a key, by binary search over the cuts."""
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    here = F.lit(cuts).cast("array<long>")
    return F.aggregate(
        F.lit(steps).cast("array<int>"),
        F.lit(0).cast("int"),
        lambda at, step: F.when(
            (at + step <= len(cuts)) & (F.element_at(here, F.least(at + step, F.lit(len(cuts)))) <= key), at + step
        ).otherwise(at),
    ) - F.lit(1)


def number_rows(df: DataFrame, key: str, ties: list[str], out: str, pieces: int | None = None) -> tuple[DataFrame, int]:
    """Add ``out``: the row's 0-based place by (key, ties) in the whole table; and the number of rows."""
    cuts = key_cuts(df, key, pieces)
    if not cuts:
        return df.withColumn(out, F.lit(None).cast("long")), 0
    cut = df.withColumn("_piece", piece_of(F.col(key), cuts))
    counts = dict(cut.groupBy("_piece").count().collect())  # one row per piece
    before, total = [], 0
    for i in range(len(cuts)):
        before.append(total)
        total += counts.get(i, 0)
    w = Window.partitionBy("_piece").orderBy(key, *ties)
    first = F.element_at(F.lit(before).cast("array<long>"), F.col("_piece") + 1)
    return cut.withColumn(out, first + F.row_number().over(w) - 1).drop("_piece"), total
