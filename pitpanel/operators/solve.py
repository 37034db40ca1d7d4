"""Small dense solves. All data reduction happens in Spark; Python only sees moments or one key's bounded history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A


# --------------------------------------------------------------------------- ridge from moments
def moment_columns(features, y: str) -> list[Column]:
    """Sums that determine a standardised ridge: n, y, x, xy and the upper triangle of xx'."""
    xs = [F.col(f) for f in features]
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    keep = lambda c: F.when(ok, c)
    out = [keep(F.lit(1.0)), keep(F.col(y))] + [keep(x) for x in xs] + [keep(x * F.col(y)) for x in xs]
    return out + [keep(xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]


def ridge_from_moments(m: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Batch of moment rows -> [intercept, coefficients on the original scale, mean x, sd x]."""
    n, sy, sx, sxy = m[:, 0], m[:, 1], m[:, 2 : 2 + p], m[:, 2 + p : 2 + 2 * p]
    xx = np.zeros((len(m), p, p))
    iu = np.triu_indices(p)
    xx[:, iu[0], iu[1]] = m[:, 2 + 2 * p :]
    xx[:, iu[1], iu[0]] = m[:, 2 + 2 * p :]
    mean, ybar = sx / n[:, None], sy / n
    cov = xx - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.einsum("kii->ki", cov), 0) / n[:, None])
    sd[sd <= 1e-12] = 1.0
    a = cov / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(p)
    b = (sxy - n[:, None] * mean * ybar[:, None]) / sd
    beta = np.linalg.solve(a, b[:, :, None])[:, :, 0] / sd
    return np.hstack([(ybar - (beta * mean).sum(1))[:, None], beta, mean, sd])


def ridge_udf(p: int, alpha: float):
    """Vectorised over the Arrow batch: every non-null row is one solve of a p x p system."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(moments: pd.Series) -> pd.Series:
        live = [m is not None for m in moments]
        if not any(live):
            return pd.Series([None] * len(moments), dtype=object)
        rows = np.stack([m for m in moments if m is not None]).astype(float)
        fitted = iter(ridge_from_moments(rows, p, alpha))
        return pd.Series([next(fitted) if k else None for k in live], dtype=object)

    return solve


def linear(coef: Column, features) -> Column:
    """intercept + sum coef * x for a [intercept, coef...] array."""
    out = F.get(coef, F.lit(0))
    for i, f in enumerate(features):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(f)
    return out


def refit_flags(pos: Column, first: Column | int, step: int) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    return (pos >= first) & ((pos - first) % step == 0)


def walk_forward_ridge(
    df: DataFrame, features, y: str, h: int, step: int, first: Column | int, min_rows: int, alpha: float, keys=("entity",), quantiles=()
) -> DataFrame:
    """Expanding ridge, refit every `step` rows on rows <= refit - h; coefficients are carried to the next refit.

    All refits of all keys come from one pass of running moments (prefix sums);
    no row is copied per refit. With `quantiles`, in-sample residual quantiles
    and history-only quantiles of each refit are carried as well.
    """
    w: WindowSpec = Window.partitionBy(*keys).orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -h)
    is_fit = refit_flags(F.col("pos"), first, step)
    moments = [F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in moment_columns(features, y)]
    d = df.withColumn("_m", F.array(*moments))
    d = d.withColumn("_m", F.when(is_fit & (F.get("_m", F.lit(0)) >= min_rows), F.col("_m")))
    if quantiles:
        x_ok = F.col(y).isNotNull()
        d = d.withColumn("_h", F.collect_list(F.when(x_ok, F.struct(F.array(*features).alias("x"), F.col(y).alias("y")))).over(past))
        d = d.withColumn("_h", F.when(F.col("_m").isNotNull(), F.col("_h")))
    d = d.withColumn("_coef", ridge_udf(len(features), alpha)("_m")).withColumn("n_train", F.get("_m", F.lit(0)))
    carried = ["_coef", "n_train"]
    if quantiles:
        p = len(features)
        slope = F.slice("_coef", 2, p)
        fit = lambda r: F.get("_coef", F.lit(0)) + F.aggregate(
            F.zip_with(r["x"], slope, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        )
        resid = F.array_sort(F.transform("_h", lambda r: r["y"] - fit(r)))
        hist = F.array_sort(F.transform("_h", lambda r: r["y"]))
        d = d.withColumn("_rs", resid).withColumn("_hs", hist)
        d = d.withColumn("_rq", F.when(F.col("_coef").isNotNull(), F.array(*[A.quantile_sorted(F.col("_rs"), q) for q in quantiles])))
        d = d.withColumn("qb", F.when(F.col("_coef").isNotNull(), F.array(*[A.quantile_sorted(F.col("_hs"), q) for q in quantiles])))
        d = d.drop("_h", "_rs", "_hs")
        carried += ["_rq", "qb"]
    recent = w.rowsBetween(-(step - 1), 0)
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(recent) for c in carried})
    d = d.withColumn("pred", linear(F.col("_coef"), features))
    if quantiles:
        d = d.withColumn("qm", F.array_sort(F.transform("_rq", lambda q: F.col("pred") + q)))
        d = d.drop("_rq")
    return d.drop("_m", "_coef")


def latest_ridge(df: DataFrame, features, y: str, alpha: float, min_rows: int, keys=("entity",)) -> DataFrame:
    """Fit on every row with a known outcome and explain the latest row: one row per (key, feature)."""
    moments = F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in moment_columns(features, y)])
    g = df.groupBy(*keys).agg(moments.alias("_m"), F.max_by(F.array(*features), "pos").alias("x"))
    g = g.filter(F.get("_m", F.lit(0)) >= min_rows).withColumn("_c", ridge_udf(len(features), alpha)("_m"))
    p = len(features)
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.get("_c", F.lit(1 + i)).alias("coef"),
                (F.get("_c", F.lit(1 + i)) * (F.get("x", F.lit(i)) - F.get("_c", F.lit(1 + p + i))) * 100.0).alias("contribution"),
            )
            for i, f in enumerate(features)
        ]
    )
    return g.select(*keys, F.explode(items).alias("o")).select(*keys, "o.*")


# --------------------------------------------------------------------------- logistic
def newton(z: np.ndarray, label: np.ndarray, live: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Weights of L2-penalised logistic fits, all of them together: z is (fits, rows, inputs), `live` marks a fit's own rows."""
    penalty = np.r_[0.0, np.full(z.shape[2] - 1, 1.0 / c)]
    w = np.zeros((len(z), z.shape[2]))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.einsum("gnk,gk->gn", z, w)))
        slope = np.einsum("gnk,gn->gk", z, (p - label) * live) + penalty * w
        bend = np.einsum("gnk,gn,gnl->gkl", z, p * (1 - p) * live, z) + np.diag(penalty)
        move = np.linalg.solve(bend + 1e-12 * np.eye(z.shape[2]), slope[:, :, None])[:, :, 0]
        w -= move
        if np.abs(move).max() < 1e-11:
            break
    return w


def logit_udf(p: int, c: float):
    """[intercept, coefficients, means, deviations] of every row's fit; a row holds one fold's inputs and label, end to end."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(folds: pd.Series) -> pd.Series:
        data = [np.asarray(f, float).reshape(-1, p + 1) for f in folds]
        longest = max(map(len, data))
        x, label, live = np.zeros((len(data), longest, p)), np.zeros((len(data), longest)), np.zeros((len(data), longest))
        for i, d in enumerate(data):
            x[i, : len(d)], label[i, : len(d)], live[i, : len(d)] = d[:, :p], d[:, p], 1.0
        n = live.sum(1)[:, None]
        mean = x.sum(1) / n
        x = (x - mean[:, None, :]) * live[:, :, None]
        sd = np.sqrt((x * x).sum(1) / n)
        sd[sd <= 1e-12] = 1.0
        w = newton(np.concatenate([live[:, :, None], x / sd[:, None, :]], axis=2), label, live, c)
        return pd.Series(list(np.hstack([w, mean, sd])))

    return solve


def logit_fits(rows: DataFrame, features, keys, c: float = 0.3, min_rows: int = 2) -> DataFrame:
    """(keys, n_train, base, fit): one penalised logistic fit per key on its learn rows; no fit where only one class is known.

    A key's rows are one fold of one entity, as long as its calendar; the folds of a batch are solved together.
    """
    one = F.array(*[F.col(f).cast("double") for f in features], (F.col("y") > 0).cast("double"))
    folds = rows.filter("learn").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), F.avg((F.col("y") > 0).cast("double")).alias("base"), F.flatten(F.collect_list(one)).alias("fold_rows"))
    folds = folds.filter(F.col("n_train") >= min_rows)
    both = (F.col("base") > 0) & (F.col("base") < 1)
    solved = folds.filter(both).withColumn("fit", logit_udf(len(features), c)("fold_rows"))
    alone = folds.filter(~both).withColumn("fit", F.lit(None).cast("array<double>"))
    return solved.unionByName(alone).drop("fold_rows")


def logit_terms(features) -> list[Column]:
    """What each input adds to the log-odds."""
    p = len(features)
    at = lambda i: F.get("fit", F.lit(i))
    return [at(1 + i) * (F.col(f) - at(1 + p + i)) / at(1 + 2 * p + i) for i, f in enumerate(features)]


def fold_logit(rows: DataFrame, features, keys, c: float = 0.3, min_rows: int = 36) -> DataFrame:
    """Probability that y > 0 and base rate for the graded rows of every key, from its learn rows alone."""
    fits = logit_fits(rows, features, keys, c, min_rows)
    score = F.get("fit", F.lit(0)) + sum(logit_terms(features)[1:], logit_terms(features)[0])
    p = F.when(F.col("fit").isNull(), F.col("base")).otherwise(1.0 / (1.0 + F.exp(-score)))
    return rows.filter("graded").join(fits, list(keys)).select(*keys, "pos", p.alias("p"), "base")


def latest_logit(rows: DataFrame, features, keys=("entity",), c: float = 0.3) -> DataFrame:
    """Fit on all known rows, read the latest one: probability, base rate and exact log-odds contributions.

    One class, or fewer than two rows, has coefficients of 0 and the base rate as probability (1/2 without any row).
    """
    now = rows.groupBy(*keys).agg(F.max_by(F.struct(*features), "pos").alias("x")).select(*keys, "x.*")
    d = now.join(logit_fits(rows, features, keys, c), list(keys), "left")
    terms = logit_terms(features)
    base = F.coalesce("base", F.lit(0.5))
    p = F.when(F.col("fit").isNull(), base).otherwise(1.0 / (1.0 + F.exp(-(F.get("fit", F.lit(0)) + sum(terms[1:], terms[0])))))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.get("fit", F.lit(1 + i)), F.lit(0.0)).alias("coef"), terms[i].alias("contribution")) for i, f in enumerate(features)])
    return d.select(*keys, F.explode(each).alias("o"), p.alias("p"), base.alias("base")).select(*keys, "o.*", "p", "base")
