"""Signals to weights to returns to performance: aligned-column arithmetic, so every variant is a key column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from .states import FAV, NEU, UNF

# asset and alternative weight for Favorable / Neutral / Unfavorable, fixed values
MAPS = {
    "Scaled": ((1.0, 0.5, 0.0), (0.0, 0.0, 0.0)),
    "Defensive": ((1.0, 0.25, 0.0), (0.0, 0.0, 0.0)),
    "Aggressive": ((1.0, 0.75, 0.25), (0.0, 0.0, 0.0)),
    "Only when favorable": ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0)),
    "Hold unless unfavorable": ((1.0, 1.0, 0.0), (0.0, 0.0, 0.0)),
    "Rotate": ((1.0, 0.0, 0.0), (0.0, 1.0, 1.0)),
    "Three-way": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)),
}
STRATEGIES = (*MAPS, "Trend only", "Macro + trend", "Vol-capped")
NO_SIGNAL = ("Trend only",)


def by_verdict(v: Column, values) -> Column:
    return F.when(v == FAV, values[0]).when(v == NEU, values[1]).when(v == UNF, values[2])


def strategy_weights(df: DataFrame, strategies=STRATEGIES, vol_target: float = 0.5, verdict="verdict", trend="trend", vol="vol") -> DataFrame:
    """One row per (row, strategy) with weights wa (asset), wb (alternative), wc (cash)."""
    v, up = F.col(verdict), F.coalesce(F.col(trend), F.lit(False))
    cap = F.coalesce(C.clip(F.try_divide(F.lit(vol_target), F.col(vol)), 0.0, 1.0), F.lit(1.0))

    def legs(name: str) -> tuple[Column, Column]:
        if name in MAPS:
            a, b = MAPS[name]
            return by_verdict(v, a), by_verdict(v, b)
        if name == "Trend only":
            return up.cast("double"), F.lit(0.0)
        if name == "Macro + trend":
            return ((v != UNF) & up).cast("double"), F.lit(0.0)
        return by_verdict(v, MAPS["Scaled"][0]) * cap, F.lit(0.0)

    items = [F.struct(F.lit(s).alias("strategy"), legs(s)[0].alias("wa"), legs(s)[1].alias("wb")) for s in strategies]
    out = df.withColumn("_s", F.explode(F.array(*items))).select("*", "_s.*").drop("_s")
    return out.withColumn("wc", 1.0 - F.col("wa") - F.col("wb"))


def portfolio_return(df: DataFrame, keys, bps: Column, collateral: Column, ra="ra", rb="rb", rf="rf", order="pos") -> DataFrame:
    """ret = weights x returns + collateral - turnover x bps; a zero weight ignores a missing return, missing results are dropped.

    The first row trades into its weights.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    leg = lambda wt, r: F.when(F.col(wt) == 0, F.lit(0.0)).otherwise(F.col(wt) * F.col(r))
    step = F.abs(F.col("wa") - F.lag("wa").over(w)) + F.abs(F.col("wb") - F.lag("wb").over(w))
    d = df.withColumn("turn", F.coalesce(step, F.col("wa") + F.col("wb")))
    d = d.withColumn("ret", leg("wa", ra) + leg("wb", rb) + leg("wc", rf) + collateral - F.col("turn") * bps / 10000.0)
    return d.filter(F.col("ret").isNotNull())


def performance(df: DataFrame, keys, ret="ret", rf="rf", order="pos", extra=()) -> DataFrame:
    """CAGR, volatility, Sharpe, Sortino, Calmar and maximum drawdown; NULL below two rows or for a zero denominator."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_eq", C.compound(ret, w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_dd", F.try_divide(F.col("_eq"), F.max("_eq").over(w)) - 1.0)
    ex = F.col(ret) - F.coalesce(F.col(rf), F.lit(0.0))
    down = F.least(ex, F.lit(0.0))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("_eq", order).alias("_end"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(12.0))).alias("vol"),
        F.avg(ex).alias("_ex"),
        (F.sqrt(F.avg(down * down)) * F.sqrt(F.lit(12.0))).alias("_dn"),
        F.min("_dd").alias("max_dd"),
        *extra,
    )
    ok = F.col("n") >= 2
    year = F.col("_ex") * 12.0
    pos = lambda c: F.when(c > 0, c)
    cagr = F.when(F.col("_end") >= 0, F.pow(F.col("_end"), 12.0 / F.col("n"))) - 1.0
    return g.withColumns(
        {
            "cagr": F.when(ok, cagr),
            "sharpe": F.when(ok, year / pos(F.col("vol"))),
            "sortino": F.when(ok, year / pos(F.col("_dn"))),
            "max_dd": F.when(ok, F.col("max_dd")),
            "calmar": F.when(ok & (F.col("max_dd") < 0), cagr / F.abs(F.nullif(F.col("max_dd"), F.lit(0.0)))),
        }
    ).drop("_end", "_ex", "_dn")


TRADING = (("trades", lambda: F.count(F.when(F.col("turn") > 0, 1))), ("invested", lambda: F.avg(F.col("wa") + F.col("wb"))))


def trading_aggs():
    return [f().alias(n) for n, f in TRADING]


def static_mix(weights: DataFrame, keys) -> DataFrame:
    """Same mean weights every row, no timing and no cost."""
    w = Window.partitionBy(*keys)
    d = weights.withColumns({"wa": F.avg("wa").over(w), "wb": F.avg("wb").over(w)})
    return d.withColumn("wc", 1.0 - F.col("wa") - F.col("wb"))


def benchmarks(df: DataFrame, mix: float, collateral: Column, ra="ra", rb="rb", rf="rf") -> DataFrame:
    """Buy and hold of both assets, a fixed mix and cash, as one long table."""
    a, b = F.col(ra) + collateral, F.col(rb) + collateral
    items = [("Asset buy & hold", a), ("Alternative buy & hold", b), ("Fixed mix", mix * a + (1 - mix) * b), ("Cash", F.col(rf))]
    arr = F.array(*[F.struct(F.lit(n).alias("benchmark"), r.alias("ret")) for n, r in items])
    return df.withColumn("_b", F.explode(arr)).select("*", "_b.*").drop("_b").filter(F.col("ret").isNotNull())


def rolling_sharpe(df: DataFrame, keys, n: int = 36, ret="ret", rf="rf", order="pos") -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    ex = F.col(ret) - F.coalesce(F.col(rf), F.lit(0.0))
    return F.try_divide(C.rolling(F.avg, ex, n, n, w) * 12.0, C.rolling(F.stddev_samp, F.col(ret), n, n, w) * F.sqrt(F.lit(12.0)))


def shift_amounts(length: Column, draws: int, seed: int = 0) -> Column:
    """Random circular shifts in [lo, max(L - lo, lo + 1)) with lo = max(6, L // 10)."""
    lo = F.greatest(F.lit(6), F.floor(length / 10).cast("int"))
    hi = F.greatest(length - lo, lo + 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(draws - 1)),
        lambda r: F.struct(r.alias("rep"), (lo + A.uniform_int(hi - lo, r, 0, seed)).cast("int").alias("shift")),
    )


def shifted_sharpe(df: DataFrame, keys, draws: int, bps: float, graded: Column, collateral_rate: Column, seed: int = 0, order="pos") -> DataFrame:
    """Sharpe ratio of the strategy under each circular shift of its weights: one row per (keys, rep).

    The weights of a key are one array (its calendar); shift k reads element
    (i - k) mod L, so replicates never multiply rows in a shuffle.
    """
    row = F.struct(
        F.col(order).alias("o"), F.col("wa").alias("wa"), F.col("wb").alias("wb"), F.col("ra").alias("ra"), F.col("rb").alias("rb"),
        F.col("rf").alias("rf"), graded.alias("g"), collateral_rate.alias("c"),
    )
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r")).withColumn("_n", F.size("_r"))
    g = g.withColumn("_k", F.explode(shift_amounts(F.col("_n"), draws, seed)))
    n, k = F.col("_n"), F.col("_k.shift")
    at = lambda i: F.get("_r", F.pmod(i - k, n).cast("int"))

    def ret(i: Column) -> Column:
        r, s, prev = F.get("_r", i), at(i), at(i - 1)
        wa, wb = s["wa"], s["wb"]
        wc = 1.0 - wa - wb
        leg = lambda wt, x: F.when(wt == 0, F.lit(0.0)).otherwise(wt * x)
        turn = F.when(i == 0, wa + wb).otherwise(F.abs(wa - prev["wa"]) + F.abs(wb - prev["wb"]))
        value = leg(wa, r["ra"]) + leg(wb, r["rb"]) + leg(wc, r["rf"]) + (wa + wb) * r["c"] - turn * bps / 10000.0
        return F.struct(F.when(r["g"], value).alias("ret"), r["rf"].alias("rf"))

    path = F.filter(F.transform(F.sequence(F.lit(0), n - 1), ret), lambda v: v["ret"].isNotNull())
    g = g.select(*keys, F.col("_k.rep").alias("rep"), F.col("_k.shift").alias("shift"), path.alias("_v"))
    m = F.size("_v").cast("double")
    total = lambda f: F.aggregate("_v", F.lit(0.0), lambda a, v: a + f(v))
    mean = F.try_divide(total(lambda v: v["ret"]), m)
    g = g.withColumn("_mean", mean).withColumn("_ex", F.try_divide(total(lambda v: v["ret"] - F.coalesce(v["rf"], F.lit(0.0))), m))
    var = F.try_divide(total(lambda v: (v["ret"] - F.col("_mean")) * (v["ret"] - F.col("_mean"))), m - 1.0)
    g = g.withColumn("_vol", F.sqrt(F.greatest(var, F.lit(0.0))) * F.sqrt(F.lit(12.0)))
    return g.select(*keys, "rep", "shift", F.when(F.col("_vol") > 1e-12, F.col("_ex") * 12.0 / F.nullif(F.col("_vol"), F.lit(0.0))).alias("null_sharpe"))
