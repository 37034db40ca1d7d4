"""Overlap-robust statistics, ranks and resampling; every loop variable is a key column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C


def hac_t(df: DataFrame, keys, y: str, d: str, lags: int | str, order: str = "pos", extra=(), most: int | None = None) -> DataFrame:
    """Newey-West t of b in y = a + b d, Bartlett weights, one row per key.

    `lags` is a number, or a key column of numbers up to `most`.

    Closed form of the 2x2 sandwich: the influence of row t on b is
    u = e (n d - sum d) / D, so the variance is a weighted sum of lagged products
    of u. A constant regressor (D = 0) follows the minimum-norm solution.
    `extra` are further aggregates computed in the same pass.
    """
    w, wo = C.whole(*keys, order=order), Window.partitionBy(*keys).orderBy(order)
    m = df.withColumns(
        {
            "_n": F.count(F.lit(1)).over(w).cast("double"),
            "_sy": F.sum(y).over(w),
            "_sd": F.sum(d).over(w),
            "_sdd": F.sum(F.col(d) * F.col(d)).over(w),
            "_sdy": F.sum(F.col(d) * F.col(y)).over(w),
        }
    )
    n, sy, sd, sdd, sdy = (F.col(c) for c in ("_n", "_sy", "_sd", "_sdd", "_sdy"))
    m = m.withColumn("_D", n * sdd - sd * sd)
    big, c = F.col("_D"), sd / n
    m = m.withColumn("_b", F.when(big > 0, (n * sdy - sd * sy) / F.nullif(big, F.lit(0.0))).otherwise(c * (sy / n) / (1 + c * c)))
    b = F.col("_b")
    e = F.col(y) - (sy - b * sd) / n - b * F.col(d)
    m = m.withColumn("_u", e * F.when(big > 0, (n * F.col(d) - sd) / F.nullif(big, F.lit(0.0))).otherwise(c / (n * (1 + c * c))))
    m = m.withColumns({f"_u{k}": F.col("_u") * F.lag("_u", k).over(wo) for k in range(1, (most or lags) + 1)})
    var = F.sum(F.col("_u") * F.col("_u"))
    for k in range(1, (most or lags) + 1):
        weight = F.greatest(1.0 - k / (F.col(lags) + 1.0), F.lit(0.0)) if isinstance(lags, str) else F.lit(1.0 - k / (lags + 1.0))
        var = var + 2.0 * weight * F.coalesce(F.sum(f"_u{k}"), F.lit(0.0))
    return (
        m.groupBy(*keys)
        .agg(F.first("_b").alias("_b"), var.alias("_var"), *extra)
        .withColumn("t", F.when(F.col("_var") > 0, F.col("_b") / F.sqrt(F.greatest(F.col("_var"), F.lit(0.0)))).otherwise(0.0))
        .drop("_b", "_var")
    )


def bh_q(df: DataFrame, family, p: str = "p", ties=(), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values inside each family of tests."""
    by_p = Window.partitionBy(*family).orderBy(p, *ties)
    n = F.count(p).over(Window.partitionBy(*family))
    step = df.withColumn("_rn", F.row_number().over(by_p)).withColumn("_r", F.col(p) * n / F.col("_rn"))
    tail = Window.partitionBy(*family).orderBy("_rn").rowsBetween(0, Window.unboundedFollowing)
    return step.withColumn(out, F.least(F.min("_r").over(tail), F.lit(1.0))).drop("_rn", "_r")


def rank_ic(df: DataFrame, keys, x: str, y: str, out: str = "ic", min_n: int = 8) -> DataFrame:
    """Spearman correlation per key over complete pairs (average ranks)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    ranked = df.filter(both).withColumn("_rx", C.avg_rank(x, *keys)).withColumn("_ry", C.avg_rank(y, *keys))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), C.pearson("_rx", "_ry", min_n).alias(out))


def row_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks inside each row of a matrix."""
    less = (x[:, None, :] < x[:, :, None]).sum(2)
    same = (x[:, None, :] == x[:, :, None]).sum(2)
    return less + (same + 1) / 2.0


def row_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a.shape[1]
    sa, sb = a.sum(1), b.sum(1)
    den = np.sqrt((n * (a * a).sum(1) - sa * sa) * (n * (b * b).sum(1) - sb * sb))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, (n * (a * b).sum(1) - sa * sb) / den, np.nan)


@lru_cache(maxsize=None)
def _rank_corr_udf(win: int):
    @F.pandas_udf("double")
    def rank_corr(xs: pd.Series, ys: pd.Series) -> pd.Series:
        live = np.array([v is not None and len(v) == win for v in xs])
        out = np.full(len(xs), np.nan)
        if live.any():
            a, b = np.stack(list(xs[live])), np.stack(list(ys[live]))
            for lo in range(0, len(a), 2000):  # bounds the win x win comparison block
                part = slice(lo, lo + 2000)
                a_r, b_r = row_ranks(a[part]), row_ranks(b[part])
                out[np.flatnonzero(live)[part]] = row_correlation(a_r, b_r)
        return pd.Series(out)

    return rank_corr


def rolling_rank_ic(df: DataFrame, keys, x: str, y: str, win: int, order: str = "pos") -> DataFrame:
    """Spearman correlation inside each trailing window, re-ranked per window.

    The frame is a fixed `win` pairs, carried as arrays by the window itself and
    ranked in Arrow batches; rows are never multiplied.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(win - 1), 0)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = pairs.withColumns({"_x": F.collect_list(x).over(frame), "_y": F.collect_list(y).over(frame)})
    return pairs.withColumn("ic", C.finite(_rank_corr_udf(win)("_x", "_y"))).drop("_x", "_y")


def spearman_pairs(df: DataFrame, features, keys=("entity",)) -> DataFrame:
    """Rank correlation of every feature pair on complete rows.

    Ranks become columns and the pairs are sums of products in one aggregate (a
    Gram matrix with shared marginal sums), so rows are read once and never
    joined with one another.
    """
    features = list(features)
    ranked = df.dropna(subset=features).select(*keys, *[C.avg_rank(f, *keys).alias(f) for f in features])
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    squares = [F.sum(F.col(f) * F.col(f)).alias(f"q{i}") for i, f in enumerate(features)]
    products = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i, j in pairs]
    g = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *squares, *products)
    n = F.col("n")
    spread = [n * F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") for i in range(len(features))]

    def rho(i: int, j: int) -> Column:
        return F.try_divide(n * F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}"), F.sqrt(spread[i] * spread[j]))

    items = [F.struct(F.lit(features[i]).alias("feature_a"), F.lit(features[j]).alias("feature_b"), rho(i, j).alias("rho")) for i, j in pairs]
    return g.select(*keys, F.explode(F.array(*items)).alias("p")).select(*keys, "p.*")


# --------------------------------------------------------------------------- moving-block bootstrap
def series_array(value: str, order: str = "pos") -> Column:
    """Aggregate: the values of a bounded group in row order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])


def block_lengths(n: Column, block: int) -> tuple[Column, Column]:
    b = F.greatest(F.lit(1), F.least(F.lit(block), n))
    return b, F.ceil(n / b).cast("int")


def block_starts(n: int, block: int, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (reps x blocks) and lengths of the moving blocks of a series of n values; same hash as `uniform_int`."""
    b = max(1, min(block, n))
    i = np.arange(-(-n // b), dtype=np.int64)
    r = np.arange(reps, dtype=np.int64)[:, None]
    z = (r * 1000003 + i * 7919 + (seed * 104729 + 12345)) % A.LCG_M
    z = (z * z + r * 31 + i) % A.LCG_M
    z = (z * z + 48271 * i + 7) % A.LCG_M
    return z % (n - b + 1), np.minimum(b, n - i * b)


@lru_cache(maxsize=None)
def _block_ci_udf(block: int, reps: int, seed: int):
    @F.pandas_udf("array<double>")
    def interval(series: pd.Series) -> pd.Series:
        out = []
        for v in series:
            if len(v) < 5:
                out.append(None)
                continue
            s, length = block_starts(len(v), block, reps, seed)
            p = np.r_[0.0, np.cumsum(v)]  # a block's sum is a difference of two prefix sums
            out.append(np.percentile((p[s + length] - p[s]).sum(1) / len(v), [2.5, 97.5]).tolist())
        return pd.Series(out, dtype=object)

    return interval


def block_ci(df: DataFrame, keys, value: str, block: int, reps: int = 1000, order: str = "pos", seed: int = 0) -> DataFrame:
    """Approximate 95% interval of the mean per key; NULL below five values.

    One aggregate collects each key's series (bounded by its calendar). A
    replicate costs one lookup per block; resampled rows never exist.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(series_array(value, order).alias("_v"))
    g = g.withColumn("_ci", _block_ci_udf(block, reps, seed)("_v"))
    return g.select(
        *keys,
        F.size("_v").cast("bigint").alias("n"),
        F.get("_ci", F.lit(0)).alias("lo"),
        F.get("_ci", F.lit(1)).alias("hi"),
    )


def block_positions(df: DataFrame, n: str, block: int, reps: int, keys, seed: int = 0) -> DataFrame:
    """Resampled row positions (rep, draw, pos) per key; one input row per key."""
    b, nb = block_lengths(F.col(n), block)
    rep = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_b", b)
    blk = rep.withColumn("_i", F.explode(F.sequence(F.lit(0), nb - 1)))
    start = A.uniform_int(F.col(n) - F.col("_b") + 1, F.col("rep"), F.col("_i"), seed).cast("int")
    return (
        blk.withColumn("_s", start)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("draw", F.col("_i") * F.col("_b") + F.col("_o"))
        .filter(F.col("draw") < F.col(n))
        .select(*keys, "rep", "draw", (F.col("_s") + F.col("_o")).alias("pos"))
    )


def auc_counts(df: DataFrame, keys, p: str, y: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks, NULL for a single class."""
    r = df.withColumn("_r", C.avg_rank(p, *keys))
    n1 = F.sum(F.col(y).cast("double"))
    n0 = F.count(F.lit(1)) - n1
    s = F.sum(F.when(F.col(y) == 1, F.col("_r")))
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(s - n1 * (n1 + 1) / 2.0, n1 * n0).alias("auc")
    )


def perm_p(df: DataFrame, keys, null: str, obs: str, min_n: int = 20) -> DataFrame:
    """Share of null draws at least as good as the observed score, with the null median and 95th percentile."""
    v = F.col(null)
    n = F.count(v)
    ok = (n >= min_n) & F.first(obs).isNotNull()
    return df.groupBy(*keys).agg(
        n.alias("n_null"),
        F.when(ok, (F.count(F.when(v >= F.col(obs), 1)) + 1) / (n + 1)).alias("p"),
        F.when(ok, F.percentile(v, 0.5)).alias("null_median"),
        F.when(ok, F.percentile(v, 0.95)).alias("null_p95"),
    )


def outcome_summary(groups: DataFrame, keys, group: str, y: str, dd: str | None = None) -> DataFrame:
    """Months, mean, median, share positive, worst and best per group plus an 'All months' row."""
    v = F.col(y)
    aggs = [
        F.count(v).alias("months"),
        F.avg(v).alias("avg"),
        F.percentile(v, 0.5).alias("median"),
        F.avg((v > 0).cast("double")).alias("win"),
        F.min(v).alias("worst"),
        F.max(v).alias("best"),
    ]
    if dd:
        aggs.append(F.percentile(F.col(dd), 0.5).alias("dd"))
    sets = [[*[F.col(k) for k in keys], F.col(group)], [F.col(k) for k in keys]]
    return (
        groups.groupingSets(sets, *keys, group)
        .agg(F.grouping(group).alias("_all"), *aggs)
        .withColumn(group, F.when(F.col("_all") == 1, "All months").otherwise(F.col(group)))
        .drop("_all")
    )


@lru_cache(maxsize=None)
def _auc_ci_udf(block: int, reps: int, seed: int):
    @F.pandas_udf("struct<reps:bigint,lo:double,hi:double>")
    def interval(probs: pd.Series, labels: pd.Series) -> pd.DataFrame:
        rows = []
        for p, lab in zip(probs, labels):
            n = len(p)
            s, length = block_starts(n, block, reps, seed)
            weight = np.zeros((reps, n + 1))  # how often each original row is drawn, by difference arrays
            rep = np.repeat(np.arange(reps), s.shape[1])
            np.add.at(weight, (rep, s.ravel()), 1.0)
            np.add.at(weight, (rep, (s + length).ravel()), -1.0)
            weight = weight.cumsum(1)[:, :n]
            # group rows by distinct probability, then count wins and half ties group by group
            _, group = np.unique(p, return_inverse=True)
            onehot = np.eye(group.max() + 1)[group]
            up, down = (weight * lab) @ onehot, (weight * (1 - lab)) @ onehot
            below = down.cumsum(1) - down
            total = up.sum(1) * down.sum(1)
            auc = ((up * (below + 0.5 * down)).sum(1)[total > 0]) / total[total > 0]
            ok = n >= 20 and len(auc) > 20
            lo, hi = np.percentile(auc, [2.5, 97.5]) if ok else (None, None)
            rows.append((len(auc), lo, hi))
        return pd.DataFrame(rows, columns=["reps", "lo", "hi"]).astype({"lo": float, "hi": float})

    return interval


def auc_ci(df: DataFrame, keys, p: str, label: str, index: str, block: int, reps: int, seed: int = 0) -> DataFrame:
    """95% interval of the AUC by moving-block resampling of (probability, label) pairs.

    A replicate is a weight per original row, so no resampled copy is sorted or
    shuffled; one-class replicates are skipped.
    """
    g = df.groupBy(*keys).agg(series_array(p, index).alias("_p"), series_array(label, index).alias("_l"))
    g = g.select(*keys, _auc_ci_udf(block, reps, seed)("_p", "_l").alias("_c"))
    return g.select(*keys, "_c.reps", C.finite("_c.lo").alias("lo"), C.finite("_c.hi").alias("hi"))
