"""Histogram trees of many models at once: the rows' bins are made in Spark, one call here is one level of all trees of a task.

A cell is one node of one model (a fold, a quantile, a bagged tree). All histograms of a level, over (cell, feature, bin),
are a few weighted counts; there is no loop over models, folds or nodes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folds of a key that one task takes at a time.
LOT = 32
# splitmix64: fixed values
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def binned(rows: DataFrame, features, keys, bins: int) -> DataFrame:
    """`bins` of every row: for each feature how many of the cut points (quantiles) of its key's learn rows lie below it.

    `rows` holds the keys, pos, learn, label and the features; n_train and base are of the learn rows.
    """
    at = [i / bins for i in range(1, bins)]
    cuts = rows.filter("learn").groupBy(*keys).agg(*[F.percentile(f, at).alias(f"_cut_{f}") for f in features], F.count(F.lit(1)).alias("n_train"), F.avg("label").alias("base"))
    below = lambda f: F.size(F.filter(f"_cut_{f}", lambda c: c < F.col(f)))
    joined = rows.join(cuts, list(keys)).withColumn("bins", F.array(*map(below, features)))
    return joined.select(*keys, "pos", "learn", "label", "n_train", "base", "bins")


def lots(rows: DataFrame, keys, fold=("fold",)) -> DataFrame:
    """The folds of every key in lots, so that a task holds a bounded number of copies of a key's rows; `fold` names what numbers them."""
    return rows.withColumn("lot", F.floor(F.dense_rank().over(Window.partitionBy(*keys).orderBy(*fold)) / LOT).cast("int"))


def draws(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64 random-looking bits for each pair of numbers."""
    with np.errstate(over="ignore"):
        u = a.astype(np.uint64) * GOLDEN + (b.astype(np.uint64) + np.uint64(1)) * MIX1 + np.uint64(seed) * MIX2
        u = (u ^ (u >> np.uint64(30))) * MIX1
        u = (u ^ (u >> np.uint64(27))) * MIX2
        return u ^ (u >> np.uint64(31))


def group_quantiles(values: np.ndarray, group: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Linear quantile of the values of each group, at the group's own level; 0 where a group has none."""
    n = np.bincount(group, minlength=len(level))
    v = np.append(values[np.lexsort((values, group))], 0.0)
    at = np.maximum(n - 1, 0) * level
    low = np.floor(at).astype(np.int64)
    first = np.cumsum(n) - n + low
    a, b = v[np.minimum(first, len(v) - 1)], v[np.minimum(first + (at > low), len(v) - 1)]
    return np.where(n > 0, a + (at - low) * (b - a), 0.0)


def best_splits(cell: np.ndarray, bins: np.ndarray, weight: np.ndarray, value: np.ndarray, cells: int, min_leaf: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), last left bin and gain of the best split of each cell.

    `cell`, `weight`, `value` and the rows of `bins` are the rows in use; the gain is the weighted decrease of the squared
    error of the values (for labels of 0 and 1 that of the Gini impurity, but for a factor of 2). A side needs `min_leaf` rows.
    Of equal gains the first feature and bin win.
    """
    width, n_features = int(bins.max(initial=0)) + 1, bins.shape[1]
    gain = np.empty((cells, n_features, width))
    for f in range(n_features):
        slot = cell * width + bins[:, f]
        rows, mass, total = (np.bincount(slot, w, minlength=cells * width).reshape(cells, width).cumsum(1) for w in (None, weight, weight * value))
        right = [x[:, -1:] - x for x in (rows, mass, total)]
        fits = (rows >= min_leaf[:, None]) & (right[0] >= min_leaf[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain[:, f] = np.where(fits, mass * right[1] / (mass + right[1]) * (total / mass - right[2] / right[1]) ** 2, -1.0)
    if allowed is not None:
        gain[~allowed] = -1.0
    gain = np.round(gain, 10).reshape(cells, -1)
    best = gain.argmax(1)
    most = gain[np.arange(cells), best]
    return np.where(most > 0, best // width, -1), np.where(most > 0, best % width, 0), np.maximum(most, 0.0)
