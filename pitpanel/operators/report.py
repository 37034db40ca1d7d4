"""Decision tables and the option-chain summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .states import FAV, NEU, UNF


def exposure(v: Column) -> Column:
    return F.when(v == FAV, 1.0).when(v == NEU, 0.5).when(v == UNF, 0.0)


def vote(v: Column) -> Column:
    return F.when(v == FAV, 1).when(v == UNF, -1).otherwise(0)


def exposure_label(e: Column) -> Column:
    return (
        F.when(e >= 0.99, "Favorable").when(e >= 0.7, "Leaning favorable").when(e > 0.3, "Neutral")
        .when(e > 0.01, "Leaning unfavorable").otherwise("Unfavorable")
    )


def evidence_level(n_rules: Column, n_fav: Column, n_unf: Column, spread: Column, lo_fav: Column, hi_unf: Column) -> Column:
    """Strong / Weak / None / Unknown from the unseen-period spread and the two confidence ranges."""
    apart = F.coalesce(lo_fav > hi_unf, F.lit(False))
    return (
        F.when(n_rules == 0, "None")
        .when((n_fav < 3) | (n_unf < 3), "Unknown")
        .when((spread > 2) & apart, "Strong")
        .when(spread > 0, "Weak")
        .otherwise("None")
    )


def analogue_vote(med: Column, share: Column) -> Column:
    return F.when((med > 0) & (share >= 0.55), 1).when((med < 0) & (share <= 0.45), -1).otherwise(0)


def macro_vote(total: Column) -> Column:
    """Rules, classifier and analogues read the same indicators: together they are one voice."""
    return F.when(total >= 2, 1).when(total <= -2, -1).otherwise(0)


def confidence(macro: Column, trend: Column, level: Column) -> Column:
    """Both voices must agree; the evidence level then decides."""
    agree = (macro != 0) & (macro == trend)
    return F.when(~agree, "Low").when(level == "Strong", "High").when(level == "Weak", "Medium").otherwise("Low")


def option_summary(chain: DataFrame, keys=("symbol",), spot: str = "spot") -> DataFrame:
    """At-the-money volatility near and far, skew, put/call ratios and term, one row per key.

    `chain`: key, type, dte, strike, iv, oi, vol, row_id. Two combining
    aggregates and one join on the key; a hot symbol is never gathered.
    """
    keys = list(keys)
    in_range = lambda lo, hi: F.when(F.col("dte").between(lo, hi), F.col("dte"))
    sym = chain.groupBy(*keys).agg(
        F.round(F.avg("strike"), 2).alias(spot),
        F.coalesce(F.min(in_range(14, 60)), F.min("dte")).alias("near_dte"),
        F.min(in_range(75, 200)).alias("far_dte"),
    )
    rows = chain.join(sym, keys)
    near, far = F.col("dte") == F.col("near_dte"), F.col("dte") == F.col("far_dte")
    liquid = (F.col("iv") > 0.01) & (F.coalesce("oi", F.lit(0.0)) + F.coalesce("vol", F.lit(0.0)) > 0)

    def iv_at(kind: str, when: Column, mult: float) -> Column:
        live = when & liquid & (F.col("type") == kind)
        key = F.struct(F.round(F.abs(F.col("strike") - F.col(spot) * mult), 9), F.col("strike"), F.col("row_id"))
        return F.min_by(F.col("iv"), F.when(live, key)) * 100.0

    total = lambda c, kind: F.sum(F.when(near & (F.col("type") == kind), F.coalesce(c, F.lit(0.0))).otherwise(0.0))
    g = rows.groupBy(*keys, spot, "near_dte", "far_dte").agg(
        iv_at("call", near, 1.0).alias("_cn"), iv_at("put", near, 1.0).alias("_pn"), iv_at("put", near, 0.9).alias("_pw"), iv_at("call", near, 1.1).alias("_cw"),
        iv_at("call", far, 1.0).alias("_cf"), iv_at("put", far, 1.0).alias("_pf"),
        (total("vol", "put") / F.greatest(total("vol", "call"), F.lit(1.0))).alias("pc_vol"),
        (total("oi", "put") / F.greatest(total("oi", "call"), F.lit(1.0))).alias("pc_oi"),
    )
    g = g.withColumns({"atm_near": C.row_mean("_cn", "_pn"), "atm_far": C.row_mean("_cf", "_pf"), "skew": F.col("_pw") - F.col("_cw")})
    g = g.withColumn("term", F.col("atm_far") - F.col("atm_near")).drop("_cn", "_pn", "_pw", "_cw", "_cf", "_pf")
    return g.withColumns(
        {
            "shape": F.when(F.col("term") < -1, "inverted").when(F.col("term") > 1, "normal").when(F.col("term").isNotNull(), "flat"),
            "wings": F.when(F.col("skew") < -1, "calls richer").when(F.col("skew") > 1, "puts richer").when(F.col("skew").isNotNull(), "balanced"),
        }
    )
