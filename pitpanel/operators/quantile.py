"""Quantile projections: history quantiles, shrinkage, pinball scores and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from . import order as O
from . import solve as SV
from . import targets as T

LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90)
GRID = (1, 2, 3, 4, 6, 9, 12, 18, 24)
#: Rows a fit needs, rows between refits, strength of the ridge.
MIN_ROWS, STEP, ALPHA = 48, 12, 150.0


def price_features(px: str, w) -> dict[str, Column]:
    """Momentum, volatility, trend and distance from the 12-row high; needs `<px>_r1`."""
    out = {f"px_mom{k}": C.pct_change(px, k, w) for k in (1, 3, 6, 12)}
    out["px_vol12"] = C.rolling(F.stddev_samp, f"{px}_r1", 12, 12, w) * F.sqrt(F.lit(12.0))
    out["px_trend"] = C.ratio(px, C.rolling(F.avg, px, 10, 10, w)) - 1.0
    out["px_dd12"] = C.ratio(px, C.rolling(F.max, px, 12, 12, w)) - 1.0
    return out


def log_forward(px: str, k: int, w) -> Column:
    ahead = F.lead(px, k).over(w)
    return F.when((F.col(px) > 0) & (ahead > 0), F.ln(ahead / F.col(px)))


def horizon_rows(df: DataFrame, px: str, keys=("entity",), grid=GRID) -> DataFrame:
    """One copy of a row per horizon, with its log return `yk` (null while it is not known)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    each = F.array(*[F.struct(F.lit(k).alias("horizon"), log_forward(px, k, w).alias("yk")) for k in grid])
    return df.withColumn("_o", each).select("*", F.explode("_o").alias("o")).select(*df.columns, "o.*")


def refit_rows(rows: DataFrame, cut: str = "c1", n: str = "n_all", step: int = STEP) -> DataFrame:
    """One copy of a horizon's row per refit that learns from it (the outcome was known then) or is graded on it."""
    pos, known = F.col("pos"), F.col("yk").isNotNull()
    folds = F.filter(T.fold_starts(F.col(cut), F.col(n), step), lambda s: (known & (pos <= s - F.col("horizon"))) | ((pos >= s) & (pos < s + step)))
    return rows.withColumn("fold", F.explode(folds)).withColumns({"learn": pos < F.col("fold"), "graded": pos >= F.col("fold")})


def today_rows(rows: DataFrame, n: str = "n_all") -> DataFrame:
    """One fit per horizon on every known row, read on the latest one."""
    last = F.col("pos") == F.col(n) - 1
    return rows.withColumns({"fold": F.col(n), "learn": F.col("yk").isNotNull(), "graded": last}).filter("learn or graded")


def history_quantiles(df: DataFrame, px: str, keys=("entity",), cut: str = "c1", step: int = STEP, min_rows: int = MIN_ROWS, grid=GRID, levels=LEVELS) -> DataFrame:
    """Per horizon: realised log return and the quantiles of the outcomes known at the last refit.

    No row holds a history: the exact order statistics of every refit come from running counts over value ranks.
    """
    key = [*keys, "horizon"]
    rows = horizon_rows(df, px, keys, grid)
    w = Window.partitionBy(*key).orderBy("pos")
    pos, horizon = F.col("pos"), F.col("horizon")
    rows = rows.withColumn("_known", F.count("yk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.coalesce(*[F.when(horizon == k, F.lag("_known", k).over(w)) for k in grid])
    rows = rows.withColumn("_n", n).drop("_known")
    rows = rows.withColumn("fold", (F.col(cut) + step * F.floor((pos - F.col(cut)) / step)).cast("int"))
    asks = rows.filter((pos == F.col("fold")) & (pos >= F.col(cut)) & (F.col("_n") >= min_rows)).select(*key, (pos - horizon).alias("upto"), F.col("_n").alias("n"), F.explode(O.quantile_asks(F.col("_n"), levels)).alias("a"))
    found = O.order_statistics(rows.filter("yk is not null").select(*key, "pos", F.col("yk").alias("v")), asks.select(*key, "upto", "n", "a.*"), key, O.bits_of(df))
    quantiles = found.groupBy(*key, "upto", "n").agg(O.quantiles_from(F.col("n"), levels).alias("qb")).select(*key, (F.col("upto") + horizon).alias("fold"), "qb")
    return rows.filter(pos >= F.col(cut)).drop("_n").join(quantiles, [*key, "fold"])


def ridge_fits(rows: DataFrame, features, keys, alpha: float = ALPHA, min_rows: int = MIN_ROWS) -> DataFrame:
    """(keys, n_train, coef): a standardised ridge of yk on the learn rows of every key, from sums."""
    sums = F.array(*[F.sum(c) for c in SV.moment_columns(features, "yk")])
    found = rows.filter("learn").groupBy(*keys).agg(sums.alias("_m")).withColumn("n_train", F.get("_m", F.lit(0)).cast("long"))
    return found.filter(F.col("n_train") >= min_rows).withColumn("coef", SV.ridge_udf(len(features), alpha)("_m")).drop("_m")


def ridge_quantiles(rows: DataFrame, features, keys=("entity", "horizon", "fold"), levels=LEVELS, alpha: float = ALPHA, min_rows: int = MIN_ROWS) -> DataFrame:
    """The graded rows with `pred`, the model quantiles `qm` (prediction plus residual quantiles) and those of history alone, `qb`."""
    fits = ridge_fits(rows, features, keys, alpha, min_rows)
    scored = rows.join(fits, list(keys)).withColumn("pred", SV.linear(F.col("coef"), features)).drop("coef")
    spread = scored.filter("learn").groupBy(*keys).agg(F.percentile(F.col("yk") - F.col("pred"), list(levels)).alias("_rq"), F.percentile("yk", list(levels)).alias("qb"))
    out = scored.filter("graded").join(spread, list(keys))
    return out.withColumn("qm", F.array_sort(F.transform("_rq", lambda q: F.col("pred") + q))).drop("_rq", "learn", "graded")


def ridge_drivers(rows: DataFrame, features, keys=("entity",), alpha: float = ALPHA, min_rows: int = MIN_ROWS) -> DataFrame:
    """(keys, feature, coef, contribution): what each input adds to the prediction of the graded row, in percent."""
    p = len(features)
    at = lambda i: F.get("coef", F.lit(i))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), at(1 + i).alias("b"), (at(1 + i) * (F.col(f) - at(1 + p + i)) * 100.0).alias("contribution")) for i, f in enumerate(features)])
    d = rows.filter("graded").join(ridge_fits(rows, features, keys, alpha, min_rows), list(keys))
    return d.select(*keys, F.explode(each).alias("o")).select(*keys, "o.feature", F.col("o.b").alias("coef"), "o.contribution")


def shrink(qb: Column, qm: Column, lam: Column) -> Column:
    """History quantiles moved toward the model's by lam, re-sorted."""
    return F.array_sort(F.zip_with(qb, qm, lambda b, m: b + lam * (m - b)))


def average_members(*qs: Column) -> Column:
    total = qs[0]
    for q in qs[1:]:
        total = F.zip_with(total, q, lambda a, b: a + b)
    return F.transform(total, lambda v: v / float(len(qs)))


def pinball(y: Column, q: Column, levels=LEVELS) -> Column:
    """Mean over levels of max(tau e, (tau - 1) e), e = y - q."""
    taus = F.array(*[F.lit(t) for t in levels])
    loss = F.zip_with(q, taus, lambda v, t: F.greatest(t * (y - v), (t - 1.0) * (y - v)))
    return A.array_mean(loss)


def score(df: DataFrame, keys, y="yk", qm="q", qb="qb", min_n: int = 8) -> DataFrame:
    """Rank correlation of the median, direction hits, pinball skill and coverage of the two central ranges."""
    mid = len(LEVELS) // 2
    at = lambda c, i: F.get(c, F.lit(i))
    d = df.filter(F.col(y).isNotNull()).withColumn("_mid", F.round(at(qm, mid), 12))
    d = d.withColumns({"_rx": C.avg_rank("_mid", *keys), "_ry": C.avg_rank(y, *keys)})
    v = F.col(y)
    call, real = F.signum(F.round(at(qm, mid) - at(qb, mid), 12)), F.signum(v - at(qb, mid))
    inside = lambda lo, hi: F.avg(v.between(at(qm, lo), at(qm, hi)).cast("double"))
    pm, pb = F.avg(pinball(v, F.col(qm))), F.avg(pinball(v, F.col(qb)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        C.pearson("_rx", "_ry").alias("ic"),
        F.avg(F.when(call != 0, (call == real).cast("double"))).alias("hit"),
        F.when(pb > 0, 1.0 - pm / F.nullif(pb, F.lit(0.0))).alias("skill"),
        inside(0, len(LEVELS) - 1).alias("c80"),
        inside(1, len(LEVELS) - 2).alias("c50"),
    )
    return g.filter(F.col("n") >= min_n)


def curve(knots: DataFrame, keys, length: int, horizon="horizon", q="q") -> DataFrame:
    """Quantiles at every month 0..length by linear interpolation over horizons (0 at month 0, flat after the last)."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(horizon).alias("h"), F.col(q).alias("q"))))
    g = knots.groupBy(*keys).agg(arr.alias("_k"))
    zero = F.struct(F.lit(0).alias("h"), F.transform(F.get("_k", F.lit(0))["q"], lambda _: F.lit(0.0)).alias("q"))
    g = g.withColumn("_k", F.concat(F.array(zero), F.col("_k"))).withColumn("month_ahead", F.explode(F.sequence(F.lit(0), F.lit(length))))
    m = F.col("month_ahead")
    lo, hi = F.element_at(F.filter("_k", lambda k: k["h"] <= m), -1), F.get(F.filter("_k", lambda k: k["h"] >= m), F.lit(0))
    g = g.withColumn("_lo", lo).withColumn("_hi", F.coalesce(hi, F.element_at("_k", -1)))
    f = F.coalesce(F.try_divide((m - F.col("_lo.h")).cast("double"), F.col("_hi.h") - F.col("_lo.h")), F.lit(0.0))
    return g.select(*keys, "month_ahead", F.zip_with("_lo.q", "_hi.q", lambda a, b: a + f * (b - a)).alias("q"))


def chance_positive(q: Column, levels=LEVELS) -> Column:
    """Share of the distribution above zero, read off the interpolated quantile curve (clamped to its ends)."""
    pairs = F.arrays_zip(q.alias("v"), F.array(*[F.lit(t) for t in levels]).alias("t"))
    below = F.element_at(F.concat(F.array(F.lit(None).cast("struct<v:double,t:double>")), F.filter(pairs, lambda p: p["v"] <= 0)), -1)
    above = F.get(F.filter(pairs, lambda p: p["v"] > 0), F.lit(0))
    inside = below["t"] + (0.0 - below["v"]) / (above["v"] - below["v"]) * (above["t"] - below["t"])
    return 1.0 - F.when(below.isNull(), F.lit(levels[0])).when(above.isNull(), F.lit(levels[-1])).otherwise(inside)
