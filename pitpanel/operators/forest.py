"""Random forests of all folds of a key, grown together.

The rows of every (key, fold) are cut into bins by the quantiles of that fold's own training rows. Each tree
takes a Poisson(1) number of copies of a row, and a node tries a random choice of features. One level of all
trees of all folds is one histogram over (tree, fold, node, feature, bin).
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as TR

#: Cumulative chances of 0, 1, 2, ... copies of a row, and of rows times trees that are grown at a time.
POISSON = np.array([sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(8)])
WORK = 1 << 21
BINS = 32


def copies(tree: np.ndarray, pos: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree's sample holds each row (trees x rows)."""
    u = (TR.draws(tree[:, None], pos[None, :], seed) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(POISSON, u, side="right")


def tried(tree: np.ndarray, nodes: int, n_features: int, n_tried: int, seed: int) -> np.ndarray:
    """Which features each node of each tree may split on (trees x nodes x features)."""
    u = TR.draws((tree[:, None] * nodes + np.arange(nodes))[:, :, None], np.arange(n_features)[None, None, :], seed)
    return u.argsort(axis=2).argsort(axis=2) < n_tried


def grow(bins: np.ndarray, fold: np.ndarray, pos: np.ndarray, label: np.ndarray, learn: np.ndarray, tree: np.ndarray, depth: int, min_leaf: int, n_tried: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the given trees: the sum of each row's leaf shares, and the gains (trees x folds x features) as shares of each tree's total.

    `fold` numbers the folds from 0. Children of node n of a level are 2n and 2n + 1 of the next; a node that cannot be split is its left child.
    """
    folds, n_trees, n_features = int(fold.max()) + 1, len(tree), bins.shape[1]
    weight = copies(tree, pos, seed) * learn
    t, r = np.nonzero(weight)
    w = weight[t, r].astype(float)
    node, gains = np.broadcast_to(fold, weight.shape), np.zeros((n_trees, folds, n_features))
    for level in range(depth):
        size = folds << level
        allowed = tried(tree, 1 << depth, n_features, n_tried, seed + 1 + level)[:, : 1 << level]
        allowed = np.tile(allowed, (1, folds, 1)).reshape(n_trees * size, n_features)
        feature, cut, gain = TR.best_splits(t * size + node[t, r], bins[r], w, label[r], n_trees * size, np.full(n_trees * size, min_leaf), allowed)
        np.add.at(gains, (np.repeat(np.arange(n_trees), size), np.tile(np.repeat(np.arange(folds), 1 << level), n_trees), np.maximum(feature, 0)), gain)
        own = np.arange(n_trees)[:, None] * size + node
        f = feature[own]
        node = node * 2 + ((f >= 0) & (bins[np.arange(len(fold))[None, :], np.maximum(f, 0)] > cut[own]))
    size = n_trees * (folds << depth)
    leaf = np.arange(n_trees)[:, None] * (folds << depth) + node
    mass, ones = np.bincount(leaf[t, r], w, minlength=size), np.bincount(leaf[t, r], w * label[r], minlength=size)
    share = np.divide(ones, mass, out=np.zeros(size), where=mass > 0)
    total = gains.sum(axis=2, keepdims=True)
    return share[leaf].sum(axis=0), np.divide(gains, total, out=np.zeros_like(gains), where=total > 0)


def fitted(pdf: pd.DataFrame, trees: int, depth: int, min_leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold number and probability of every row, and the importances of every fold (folds x features)."""
    bins, learn = np.stack(pdf["bins"]), pdf["learn"].to_numpy(bool)
    fold, label = pdf["fold"].rank(method="dense").to_numpy(int) - 1, np.where(learn, pdf["label"].to_numpy(float), 0.0)
    at_once, p, gains = max(1, WORK // len(pdf)), np.zeros(len(pdf)), np.zeros((fold.max() + 1, bins.shape[1]))
    for first in range(0, trees, at_once):
        share, gain = grow(bins, fold, pdf["pos"].to_numpy(), label, learn, np.arange(first, min(first + at_once, trees)), depth, min_leaf, max(1, int(bins.shape[1] ** 0.5)), seed)
        p, gains = p + share, gains + gain.sum(axis=0)
    total = gains.sum(axis=1, keepdims=True)
    return fold, p / trees, np.divide(gains, total, out=np.zeros_like(gains), where=total > 0)


def _ready(rows: DataFrame, features, keys, min_rows: int) -> tuple[DataFrame, str]:
    labelled = rows.withColumn("label", F.when(F.col("learn"), (F.col("y") > 0).cast("double")))
    ready = TR.binned(labelled, features, [*keys, "fold"], BINS).filter(F.col("n_train") >= min_rows)
    return TR.lots(ready, keys), ", ".join(f"{k} {t}" for k, t in ready.dtypes if k in keys)


def fold_forest(rows: DataFrame, features, keys=("entity",), min_rows: int = 36, trees: int = 300, depth: int = 3, min_leaf: int = 10, seed: int = 0) -> DataFrame:
    """(keys, fold, pos, n_train, base, p): probability that y > 0 for the graded rows of every fold, from its learn rows alone.

    `rows` holds the keys, fold, pos, y, learn, graded and the features, as `plans.common.fold_frame` makes them.
    """
    ready, names = _ready(rows, features, list(keys), min_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, p, _ = fitted(pdf, trees, depth, min_leaf, seed)
        return pdf.assign(p=p).loc[~pdf["learn"], [*keys, "fold", "pos", "n_train", "base", "p"]]

    return ready.groupBy(*keys, "lot").applyInPandas(run, f"{names}, fold int, pos int, n_train long, base double, p double")


def importances(rows: DataFrame, features, keys=("entity",), min_rows: int = 36, trees: int = 300, depth: int = 3, min_leaf: int = 10, seed: int = 0) -> DataFrame:
    """(keys, fold, feature, importance): each tree's impurity decreases as shares, averaged over the trees; they sum to one where any tree splits."""
    ready, names = _ready(rows, features, list(keys), min_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, _, gains = fitted(pdf, trees, depth, min_leaf, seed)
        first = pdf.iloc[np.unique(fold, return_index=True)[1]]
        return pd.concat([first.assign(feature=f, importance=gains[:, i]) for i, f in enumerate(features)])[[*keys, "fold", "feature", "importance"]]

    return ready.groupBy(*keys, "lot").applyInPandas(run, f"{names}, fold int, feature string, importance double")
