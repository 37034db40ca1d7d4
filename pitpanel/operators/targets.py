"""Outcomes, purged splits and refit folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C


def cash_rate(irx: str | Column, months: float = 1.0) -> Column:
    """Return of cash over `months` from an annual percent rate; no quote means zero."""
    return F.coalesce(F.pow(F.lit(1.0) + C.col(irx) / 100.0, F.lit(months / 12.0)) - 1.0, F.lit(0.0))


def trailing_vol(px: str, w: WindowSpec, n: int = 12) -> Column:
    """Annualised deviation of the last n one-row returns; needs `<px>_r1` = one-row change."""
    return C.stable(C.rolling(F.stddev_samp, F.col(f"{px}_r1"), n, n, w) * F.sqrt(F.lit(12.0)))


def vol_scaled(ret: Column, vol: Column, target: float) -> Column:
    scale = F.coalesce(C.clip(F.try_divide(F.lit(target), vol), 0.25, 2.0), F.lit(1.0))
    return ret * scale


def forward_drawdown(px: str, h: int, w: WindowSpec) -> Column:
    """Worst fall from a running peak inside rows t..t+h; NULL when fewer than h rows follow."""
    ahead = F.collect_list(px).over(w.rowsBetween(0, h))
    return F.when(F.size(ahead) == h + 1, A.max_drawdown(ahead))


def complete_case(df: DataFrame, cols, keys=("entity",), order: str = "month") -> DataFrame:
    """Rows where every column is present, with `pos` renumbered from 0 inside each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.dropna(subset=list(cols)).withColumn("pos", F.row_number().over(w) - 1)


def split3(df: DataFrame, y: str, h: int, train: float, val: float, keys=("entity",)) -> DataFrame:
    """Label rows learn / val / test / purged / unknown.

    Rows whose outcome window would reach into the next block are purged. `k`
    ranks rows with a known outcome; c1 and c2 are the block starts on that rank.
    """
    w, upto = C.whole(*keys), Window.partitionBy(*keys).orderBy("pos")
    known = F.col(y).isNotNull()
    out = df.withColumns(
        {
            "n_ev": F.count(y).over(w),
            "n_all": F.count(F.lit(1)).over(w).cast("int"),
            "k": F.when(known, F.count(y).over(upto) - 1),
        }
    ).withColumns(
        {
            "c1": F.floor(F.col("n_ev") * F.lit(train)).cast("int"),
            "c2": F.floor(F.col("n_ev") * F.lit(train + val)).cast("int"),
        }
    )
    k, c1, c2 = F.col("k"), F.col("c1"), F.col("c2")
    part = (
        F.when(~known, "unknown")
        .when(k < c1 - h, "learn")
        .when((k >= c1) & (k < c2 - h), "val")
        .when(k >= c2, "test")
        .otherwise("purged")
    )
    return out.withColumn("part", part)


def fold_starts(cut: Column, n: Column, step: int) -> Column:
    """Refit rows: cut, cut+step, ... below n (empty when the history is too short)."""
    return F.when(cut < n, F.sequence(cut, n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def fold_rows(df: DataFrame, h: int, step: int, inclusive: bool = False, cut: str = "c1", n: str = "n_all") -> DataFrame:
    """One copy of a row per refit that trains on it or is graded on it.

    `learn` marks rows whose outcome was already known at the refit row; the
    others are the next `step` rows. The copies are generated inside the row, so
    no fold table is joined and the partitioning by entity is kept.
    """
    bound = h - 1 if inclusive else h
    pos = F.col("pos")
    folds = F.filter(
        fold_starts(F.col(cut), F.col(n), step),
        lambda s: (pos < s - bound) | ((pos >= s) & (pos < s + step)),
    )
    return df.withColumn("fold", F.explode(folds)).withColumn("learn", (pos < F.col("fold") - bound) & F.col("y").isNotNull())


def long_form(df: DataFrame, features, keep) -> DataFrame:
    """Wide features to one row per (.., feature, x)."""
    return df.unpivot([*keep], list(features), "feature", "x")
