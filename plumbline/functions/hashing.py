"""Deterministic sampling keys.

A draw is "the n rows with the smallest key", and the key is an md5 of
``tag:seed:id``. Sizes are exact, the draw does not depend on partitioning,
file order or retries, and any SQL engine reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sorts after every hex string; the boundary that keeps all rows
ALL = "g"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw_key(tag: str, seed: int | Column, *ids: str | Column) -> Column:
    """``md5('tag:seed:id[:id...]')``, uniform over hex strings."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.lit(tag), seed.cast("string"), *[_col(i).cast("string") for i in ids]]
    return F.md5(F.concat_ws(":", *parts))


def tie_key(*ids: str | Column) -> Column:
    """Order among rows with equal scores: fixed, but unrelated to id order."""
    return draw_key("tie", 0, *ids)


def hex_number(key: Column, digits: int = 15) -> Column:
    """The first hex digits of a key as a BIGINT."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def variant_bit(col: str | Column) -> Column:
    """``md5(text) mod 2``; a hex number has the parity of its last digit."""
    return F.conv(F.right(F.md5(_col(col)), F.lit(1)), 16, 10).cast("int") % 2


def digest(*cols: str | Column) -> Column:
    """A short stand-in for long key columns: equal keys only, NULL when any is NULL.

    Shuffles, sorts and broadcasts then handle 64 characters per column
    instead of whole texts.
    """
    return F.concat(*[F.sha2(_col(c).cast("string"), 256) for c in cols])
