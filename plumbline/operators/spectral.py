"""Spectral scores of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import auroc


def _usable(vec: str) -> Column:
    """The vector as doubles; NULL where it lacks or holds a number that is none."""
    x = F.col(vec).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd, x)


def _task_sums(origins: list[list[float]]):
    """Sums of one task: per layer the rows, and the sums and products of coordinates off the origin."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = [len(o) for o in origins]
        n = [0] * len(d)
        one = [np.zeros(k) for k in d]
        two = [np.zeros((k, k)) for k in d]
        for batch in batches:
            for at, origin in enumerate(origins):
                col = batch.column(at).drop_null()
                if len(col) == 0:
                    continue
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d[at]) - origin
                n[at] += len(x)
                one[at] += x.sum(0)
                two[at] += x.T @ x
        for at, k in enumerate(d):
            if n[at]:
                cells = np.concatenate([[n[at]], one[at], two[at][np.triu_indices(k)]])
                layer = pa.array([at] * len(cells), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [layer, pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["layer", "cell", "value"]
                )

    return fold


def directions(df: DataFrame, vecs: list[str], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and ``k`` leading directions of each vector column, all from one pass over ``df``.

    A task adds up the second moments of its rows about an origin (some row's
    vector, so that nothing cancels when the mean is far from zero), and sums of
    tasks add up cell by cell. What reaches the driver is d * (d + 3) / 2 + 1
    numbers a column, whatever the rows. Columns without a usable row have no
    directions (zero vectors of length zero).
    """
    x = df.select(*[_usable(v).alias(f"_{i}") for i, v in enumerate(vecs)])
    first = [x.select(c).dropna().head() for c in x.columns]
    origins = [list(r[0]) if r else [] for r in first]
    sums = (
        x.mapInArrow(_task_sums(origins), "layer int, cell int, value double")
        .groupBy("layer", "cell")
        .agg(F.sum("value").alias("value"))
        .toPandas()
        .sort_values(["layer", "cell"])
    )
    out = []
    for at, origin in enumerate(origins):
        cells = sums.loc[sums.layer == at, "value"].to_numpy()
        if len(cells) == 0:
            out.append((np.zeros(0), np.zeros((k, 0))))
            continue
        d = len(origin)
        n, one = cells[0], cells[1 : d + 1]
        two = np.zeros((d, d))
        two[np.triu_indices(d)] = cells[d + 1 :]
        spread = np.triu(two, 1) + np.triu(two).T - np.outer(one, one) / n
        found = np.linalg.eigh(spread)[1][:, ::-1][:, :k].T
        out.append((np.asarray(origin) + one / n, np.vstack([found, np.zeros((k - len(found), d))])))
    return out


def _projections(vec: str, mean: np.ndarray, found: np.ndarray) -> tuple[Column, list[Column]]:
    """The centred vector, and the mean squares of its projections on the first 1, 2, .. directions."""
    numbers = lambda v: F.array(*[F.lit(float(a)) for a in v]).cast("array<double>")
    centred = F.zip_with(_usable(vec), numbers(mean), lambda a, b: a - b)
    total, cols = F.lit(0.0), []
    for j, v in enumerate(found):
        dot = F.aggregate(F.zip_with("_c", numbers(v), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
        total = total + dot * dot
        cols.append((total / (j + 1)).alias(f"s{j + 1}"))
    return centred, cols


def spectral_scores(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Add ``s1`` .. ``sk``, the mean squared projection on the leading directions.

    Squaring makes the sign of a direction irrelevant. Vectors that lack, or hold
    NULL or a number that is none, are not fitted and have NULL scores; vectors of
    different lengths raise an error. Scores within a tied eigenvalue depend on
    the basis taken, their sum does not.
    """
    ((mean, found),) = directions(df, [vec], k)
    centred, cols = _projections(vec, mean, found)
    return df.withColumn("_c", centred).select(*df.columns, *cols)


def layer_scores(df: DataFrame, layers: dict[str, str], k: int, ids: list[str]) -> DataFrame:
    """One row per (layer, row, k): scores of all vector columns (layer name to column), one fitting pass for all."""
    fitted = directions(df, list(layers.values()), k)
    out = None
    for (name, vec), (mean, found) in zip(layers.items(), fitted):
        centred, cols = _projections(vec, mean, found)
        scored = df.select(*ids, vec).withColumn("_c", centred).select(*ids, F.lit(name).alias("layer"), *cols)
        out = scored if out is None else out.unionByName(scored)
    return long_scores(out, [*ids, "layer"], list(range(1, k + 1)))


def long_scores(scored: DataFrame, ids: list[str], ks: list[int]) -> DataFrame:
    """One row per (k, row): the shape the sweep and the tuning read."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("score")) for k in ks])
    return scored.select(*ids, F.inline(pairs))


def spectral_auc(df: DataFrame, layers: dict[str, str], bad: str, ks: list[int]) -> DataFrame:
    """AUROC of every layer and k; one fit serves all layers and all k."""
    long = layer_scores(df, layers, max(ks), [bad]).where(F.col("k").isin(ks))
    return auroc(long, "score", bad, ["layer", "k"])
