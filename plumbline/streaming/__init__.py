"""Streams.

The engine's operators are batch: every stage reads whole tables. What applies
to a stream unchanged is a *frozen* decision, which is a stateless filter:
``frozen_filter`` turns the decisions of a certified selection into one.
``certify.keep_above``, ``arms.select_cutoff`` and ``arms.select_unflagged`` take
a streaming DataFrame as they take a batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.arms import select_cutoff, select_unflagged
from plumbline.operators.certify import keep_above

__all__ = ["frozen_cutoffs", "frozen_filter", "keep_above", "select_cutoff", "select_unflagged"]


def frozen_cutoffs(decisions: DataFrame, stratum: str | None = None) -> dict[object, float] | float | None:
    """The deployed cutoffs of stored decisions, one per certified stratum (None: one pool, refused).

    Decisions have a row per stratum, so this is a small table by construction.
    """
    rows = decisions.where(F.col("certified")).collect()
    if stratum is None:
        return rows[0]["tau"] if rows else None
    return {r[stratum]: r["tau"] for r in rows}


def frozen_filter(df: DataFrame, score: str, decisions: DataFrame, stratum: str | None = None) -> DataFrame:
    """Rows, also of a stream or of a new table, that the decisions would keep; refused strata keep nothing."""
    taus = frozen_cutoffs(decisions, stratum)
    return df.where(F.lit(False)) if taus is None else keep_above(df, score, taus, stratum)
