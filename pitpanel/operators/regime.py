"""Growth / inflation regimes, transitions between them and persistence of a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import columns as C

# (growth up, inflation up) -> regime name, fixed values
REGIMES = ("Goldilocks (growth↑ inflation↓)", "Reflation (growth↑ inflation↑)",
           "Stagflation (growth↓ inflation↑)", "Slowdown / deflation (growth↓ inflation↓)")


def signed_z(spec, learn: Column, keys=("entity",), need: int = 20) -> Column:
    """Null-skipping mean of signed z-scores by learn statistics; members with too little history are left out."""
    w = Window.partitionBy(*keys)
    parts = []
    for c, sign in spec:
        xl = F.when(learn, F.col(c))
        z = F.try_divide(sign * (F.col(c) - F.avg(xl).over(w)), F.stddev_samp(xl).over(w))
        parts.append(F.when(F.count(xl).over(w) > need, z))
    return C.row_mean(*parts)


def classify(growth: Column, inflation: Column) -> Column:
    up, down = F.when(inflation > 0, REGIMES[1]).otherwise(REGIMES[0]), F.when(inflation > 0, REGIMES[2]).otherwise(REGIMES[3])
    return F.when(growth.isNotNull() & inflation.isNotNull(), F.when(growth > 0, up).otherwise(down))


def short_name(regime: str) -> Column:
    return F.get(F.split(F.col(regime), r" \("), F.lit(0))


def transitions(df: DataFrame, regime: str, w: WindowSpec, lookback: int = 3) -> DataFrame:
    """`transition` = 'regime then → regime now' where they differ, NULL otherwise."""
    d = df.withColumn("_now", short_name(regime))
    d = d.withColumn("_then", F.lag("_now", lookback).over(w))
    changed = F.col("_then").isNotNull() & F.col("_now").isNotNull() & (F.col("_then") != F.col("_now"))
    return d.withColumn("transition", F.when(changed, F.concat_ws(" → ", "_then", "_now"))).drop("_now", "_then")


def runs(df: DataFrame, value: str, keys=("entity",)) -> DataFrame:
    """Gaps and islands: run number and position inside the run."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    d = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return d.withColumn("run_len", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("pos"))).drop("_new")


def streak_summary(df: DataFrame, value: str, y: str, known: Column, keys=("entity",), long_run: int = 3) -> DataFrame:
    """Current value and streak, median run length of the same value, outcome after long runs of it."""
    r = runs(df, value, keys)
    now = F.max_by(F.struct(F.col(value).alias("v"), F.col("run_len").alias("n")), "pos").over(Window.partitionBy(*keys))
    total = F.max("run_len").over(Window.partitionBy(*keys, "run"))
    r = r.withColumns({"_now": now, "_total": total})
    same = F.col(value) == F.col("_now.v")
    held = F.when(same & (F.col("run_len") >= long_run) & known, F.col(y))
    return r.groupBy(*keys).agg(
        F.first("_now.v").alias("current"),
        F.first("_now.n").alias("streak"),
        F.percentile(F.when(same & (F.col("run_len") == 1), F.col("_total")), 0.5).alias("typical_run"),
        F.count(held).alias("n_after"),
        F.avg(held).alias("avg_after"),
    )
