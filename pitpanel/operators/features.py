"""Feature expressions that need more than one column helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import columns as C
from . import calendar as K


def sahm_gauge(df: DataFrame, x: str, w: WindowSpec, out: str) -> DataFrame:
    """3-row mean minus the minimum of the previous twelve 3-row means."""
    m = df.withColumn("_m3", C.rolling(F.avg, x, 3, 3, w))
    past = w.rowsBetween(-12, -1)
    low = F.when(F.count("_m3").over(past) == 12, F.min("_m3").over(past))
    return m.withColumn(out, F.col("_m3") - low).drop("_m3")


def seasonal_deviation(x: str, lags, w: WindowSpec, mode: str = "percent", need: int = 3) -> Column:
    """Level against the mean of the same season in earlier years: percent, fraction or difference."""
    past = [F.lag(x, k).over(w) for k in lags]
    present = sum((p.isNotNull().cast("int") for p in past[1:]), past[0].isNotNull().cast("int"))
    ref = F.when(present >= need, C.row_mean(*past))
    if mode == "difference":
        return F.col(x) - ref
    dev = F.try_divide(F.col(x), ref) - 1.0
    return dev * 100.0 if mode == "percent" else dev


def curve_slope(c1: str, cn: str, bound: float, floor: float = 5.0) -> Column:
    """(c1 - cn) / c1 in percent, NULL for near-zero prices, clipped."""
    return C.clip(F.when(F.col(c1) > floor, C.ratio(F.col(c1) - F.col(cn), c1) * 100.0), -bound, bound)


def realised_vol(df: DataFrame, keys, day: str, px: str, out: str) -> DataFrame:
    """Annualised percent deviation of 21 business-day returns (15 needed), carried over closed days."""
    open_ = F.dayofweek(day).between(2, 6) & (F.col(px) > 5)
    d = df.withColumn("_open", F.coalesce(open_, F.lit(False)))
    wb = Window.partitionBy(*keys, "_open").orderBy(day)
    d = d.withColumn("_r", C.pct_change(px, 1, wb))
    vol = C.rolling(F.stddev_samp, "_r", 21, 15, wb) * F.sqrt(F.lit(252.0)) * 100.0
    d = d.withColumn("_v", F.when(F.col("_open"), vol))
    return d.withColumn(out, C.ffill("_v", Window.partitionBy(*keys).orderBy(day))).drop("_open", "_r", "_v")


def roll_index(df: DataFrame, keys, day: str, c1: str, c2: str) -> DataFrame:
    """Roll-adjusted return index of a long front-contract position, 100 at the start.

    On the first day after an expiry the day's P&L is measured against
    yesterday's second contract. P&L is summed within the month over the last
    price of the previous month, and months are compounded.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    mon = F.year(day) * 12 + F.month(day)
    d = df.filter(F.col(c1).isNotNull()).withColumn("_m", mon)
    d = d.withColumns({"_p": F.lag(day).over(w), "_p1": F.lag(c1).over(w), "_p2": F.lag(c2).over(w)})
    rolled = F.coalesce(K.rolls_between(F.col("_p"), F.col(day)), F.lit(False))
    prev = F.when(rolled, F.coalesce("_p2", "_p1")).otherwise(F.col("_p1"))
    d = d.withColumn("_pnl", F.coalesce(F.col(c1) - prev, F.lit(0.0)))
    in_month = Window.partitionBy(*keys, "_m").orderBy(day)
    before = Window.partitionBy(*keys).orderBy("_m").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_mtd", F.sum("_pnl").over(in_month)).withColumn("_base", F.max_by(c1, day).over(before))
    d = d.withColumn("_frac", F.when(F.col("_base") > 0, F.col("_mtd") / F.nullif(F.col("_base"), F.lit(0.0))))
    final = F.row_number().over(Window.partitionBy(*keys, "_m").orderBy(F.desc(day))) == 1
    d = d.withColumn("_mret", F.when(final, F.coalesce("_frac", F.lit(0.0))))
    level = F.coalesce(C.compound("_mret", before), F.lit(1.0))
    return d.withColumn("index", 100.0 * level * (1.0 + F.col("_frac"))).filter(F.col("index").isNotNull())


def enough(x: str, keys, need: int = 365) -> Column:
    """Does the series hold at least `need` values?"""
    return F.count(x).over(Window.partitionBy(*keys)) >= need


def chain_features(df: DataFrame, keys=("entity",), day: str = "d") -> DataFrame:
    """Network and miner features on observation dates.

    Inputs: price, mc, rc, supply, iss, fees, hash, addr, stable, sent. Every
    input needs 365 values, otherwise its features are NULL.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    src = ("price", "mc", "rc", "supply", "iss", "fees", "hash", "addr", "stable", "sent")
    d = df.select(*keys, day, *[F.when(enough(c, keys), F.col(c)).alias(c) for c in src])
    d = d.withColumn("mc", F.coalesce("mc", F.col("price") * F.col("supply")))
    mean = lambda c, n, m: C.rolling(F.avg, c, n, m, w)
    d = d.withColumns(
        {
            "nvt": C.ratio("mc", "iss"),
            "hash30": mean("hash", 30, 30),
            "hash60": mean("hash", 60, 60),
            "addr30": mean("addr", 30, 30),
            "fee30": C.clip(mean("fees", 30, 30), lo=0.0),
            "iss30": C.clip(mean("iss", 30, 30), lo=0.0),
            "st7": mean("stable", 7, 4),
        }
    )
    return d.select(
        *keys,
        day,
        C.ratio("mc", "rc").alias("cap_ratio"),
        F.try_divide(F.col("mc") - F.col("rc"), C.expanding(F.stddev_samp, "mc", 365, w)).alias("cap_z"),
        C.ratio("price", mean("price", 200, 200)).alias("px_200"),
        C.ratio("iss", mean("iss", 365, 300)).alias("iss_rel"),
        mean("nvt", 90, 60).alias("nvt_90"),
        ((C.ratio("hash30", "hash60") - 1.0) * 100.0).alias("ribbon"),
        C.safe_pct_change("hash30", 90, w).alias("hash_chg"),
        C.safe_pct_change("addr30", 90, w).alias("addr_chg"),
        (C.ratio("fee30", F.col("fee30") + F.col("iss30")) * 100.0).alias("fee_share"),
        (C.ratio("addr", "supply") * 100.0).alias("active_share"),
        C.safe_pct_change("st7", 90, w).alias("stable_chg"),
        mean("sent", 7, 4).alias("sent_7"),
    )
