"""Gradient boosting of all folds of a key together: log loss for classes, pinball loss for quantiles.

Spark cuts the rows into bins by each fold's own training rows and deals the folds out by key; inside a task one round
of all folds (and all quantiles) is a gradient histogram over (model, node, feature, bin) per level, and leaves are
refitted at once: by Newton steps for the log loss, by exact quantiles of the residuals in the leaf for the pinball loss.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as TR

#: Bins of an input.
BINS = 32


def drawn(fold: np.ndarray, pos: np.ndarray, learn: np.ndarray, share: float, number: int, seed: int) -> np.ndarray:
    """The rows of a round: of each fold the `share` of learn rows with the smallest draws."""
    order = np.lexsort((TR.draws(pos, np.full(len(pos), number), seed), ~learn, fold))
    n = np.bincount(fold)
    place = np.empty(len(fold), np.int64)
    place[order] = np.arange(len(fold)) - np.repeat(np.cumsum(n) - n, n)
    return place < np.floor(share * np.bincount(fold, learn))[fold]


def boost(bins: np.ndarray, fold: np.ndarray, pos: np.ndarray, y: np.ndarray, learn: np.ndarray, levels, rounds: int, rate: float, depth: int, share: float, min_leaf: np.ndarray, seed: int = 0) -> np.ndarray:
    """Raw scores of all rows: (quantile levels, rows), or (1, rows) in log-odds without levels. `fold` numbers the folds from 0.

    A model is one fold and one level; the folds are an axis of the histograms through the node's number.
    """
    folds, q = int(fold.max()) + 1, 1 if levels is None else len(levels)
    tau = None if levels is None else np.repeat(np.asarray(levels, float)[:, None], folds, 1)
    if levels is None:
        p = np.bincount(fold[learn], y[learn], minlength=folds) / np.maximum(np.bincount(fold[learn], minlength=folds), 1)
        with np.errstate(divide="ignore"):
            first = np.log(p / (1 - p))[None, :]
    else:
        first = np.stack([TR.group_quantiles(y[learn], fold[learn], t) for t in tau])
    raw, known = first[:, fold], np.where(learn, y, 0.0)
    for number in range(rounds):
        used = drawn(fold, pos, learn, share, number, seed)
        if levels is None:
            chance = 1.0 / (1.0 + np.exp(-raw))
            gradient = known - chance
        else:
            gradient = np.where(known > raw, tau[:, :1], tau[:, :1] - 1.0)
        node = np.broadcast_to(fold, raw.shape)
        for level in range(depth):
            n_nodes = folds << level
            least = np.tile(np.repeat(min_leaf, 1 << level), q)
            cell = (np.arange(q)[:, None] * n_nodes + node)[:, used].ravel()
            feature, cut, _ = TR.best_splits(cell, np.tile(bins[used], (q, 1)), np.ones(len(cell)), gradient[:, used].ravel(), q * n_nodes, least)
            own = np.arange(q)[:, None] * n_nodes + node
            f = feature[own]
            x = bins[np.arange(len(fold))[None, :], np.maximum(f, 0)]
            node = node * 2 + ((f >= 0) & (x > cut[own]))
        leaf = np.arange(q)[:, None] * (folds << depth) + node
        size = q * (folds << depth)
        if levels is None:
            up = np.bincount(leaf[:, used].ravel(), gradient[:, used].ravel(), minlength=size)
            down = np.bincount(leaf[:, used].ravel(), (chance * (1 - chance))[:, used].ravel(), minlength=size)
            value = np.where(down > 1e-150, up / np.where(down > 1e-150, down, 1.0), 0.0)
        else:
            value = TR.group_quantiles((known - raw)[:, used].ravel(), leaf[:, used].ravel(), np.repeat(tau.ravel(), 1 << depth))
        raw = raw + rate * value[leaf]
    return raw


def fold_classifier(rows: DataFrame, features, keys=("entity",), rounds: int = 100, rate: float = 0.05, depth: int = 2, share: float = 0.8, min_rows: int = 36) -> DataFrame:
    """(keys, fold, pos, n_train, base, p) of the graded rows of every fold; one known class gives its base rate."""
    keys = list(keys)
    labelled = rows.withColumn("label", F.when(F.col("learn"), (F.col("y") > 0).cast("double")))
    ready = TR.lots(TR.binned(labelled, features, [*keys, "fold"], BINS).filter(F.col("n_train") >= min_rows), keys)
    schema = ", ".join(f"{k} {t}" for k, t in ready.dtypes if k in keys) + ", fold int, pos int, n_train long, base double, p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = pdf["fold"].rank(method="dense").to_numpy(int) - 1
        learn, base = pdf["learn"].to_numpy(bool), pdf["base"].to_numpy(float)
        raw = boost(np.stack(pdf["bins"]), fold, pdf["pos"].to_numpy(), pdf["label"].to_numpy(float), learn, None, rounds, rate, depth, share, np.ones(fold.max() + 1))[0]
        with np.errstate(over="ignore"):
            out = pdf.assign(p=np.where((base > 0) & (base < 1), 1.0 / (1.0 + np.exp(-raw)), base))
        return out.loc[~learn, [*keys, "fold", "pos", "n_train", "base", "p"]]

    return ready.groupBy(*keys, "lot").applyInPandas(run, schema)


def fold_quantiles(rows: DataFrame, features, levels, keys=("entity",), rounds: int = 40, rate: float = 0.05, depth: int = 2, share: float = 0.8, min_rows: int = 48) -> DataFrame:
    """(keys, fold, pos, n_train, q) of the graded rows of every fold: the predicted quantiles, in order. `rows` holds the outcome as `yk`."""
    keys = list(keys)
    labelled = rows.withColumn("label", F.when(F.col("learn"), F.col("yk")))
    # a task takes the folds of all of the first key's other keys (horizons) as folds of one call
    fold_of = [*keys[1:], "fold"]
    ready = TR.lots(TR.binned(labelled, features, [*keys, "fold"], BINS).filter(F.col("n_train") >= min_rows), keys[:1], fold_of)
    schema = ", ".join(f"{k} {t}" for k, t in ready.dtypes if k in keys) + ", fold int, pos int, n_train long, q array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, learn = pdf.groupby(fold_of).ngroup().to_numpy(), pdf["learn"].to_numpy(bool)
        least = np.maximum(2, np.minimum(10, np.bincount(fold, learn) // 10))
        raw = boost(np.stack(pdf["bins"]), fold, pdf["pos"].to_numpy(), pdf["label"].to_numpy(float), learn, levels, rounds, rate, depth, share, least)
        out = pdf.assign(q=list(np.sort(raw, axis=0).T))
        return out.loc[~learn, [*keys, "fold", "pos", "n_train", "q"]]

    return ready.groupBy(*keys[:1], "lot").applyInPandas(run, schema)
