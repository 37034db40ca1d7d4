"""Expectation indicators and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import quantile as Q
from . import solve as SV

# yield-curve recession probit: intercept and slope, fixed values
PROBIT_A, PROBIT_B = -0.5333, -0.6330


def forward_short_rate(y2: Column, y1: Column) -> Column:
    """Three-month rate twelve months ahead."""
    return 1.25 * y2 - 0.25 * y1


def expected_policy_rate(ff: Column, y1: Column, y2: Column, y3m: Column) -> Column:
    return C.clip(ff + (forward_short_rate(y2, y1) - y3m), lo=0.0)


def forward_ten_year(y10: Column, y1: Column) -> Column:
    return y10 + (y10 - y1) / 10.0


def recession_probability(y10: Column, y3m: Column) -> Column:
    return 100.0 * C.normal_cdf(PROBIT_A + PROBIT_B * (y10 - y3m))


def targets(w, h: int, level: str, rate: str, price: str, flow: str) -> dict[str, tuple[Column, Column]]:
    """(own value, outcome h rows ahead) per expectation target: level, change, percent change and clipped flow."""
    flow_chg = C.clip(C.pct_change(flow, 1, w), -0.4, 0.4)
    return {
        "level": (F.col(level), F.lead(level, h).over(w)),
        "change": (F.col(rate), F.lead(rate, h).over(w) - F.col(rate)),
        "percent": (C.pct_change(price, h, w), C.forward_return(price, h, w)),
        "flow": (flow_chg, F.lead(flow_chg, h).over(w)),
    }


def grade_forecasts(long: DataFrame, keys, forecast="forecast", realised="realised", anchor="anchor", min_n: int = 24) -> DataFrame:
    """MAE of the forecast and of the no-change anchor, skill, and rank correlation of the two changes."""
    f, r, a = F.col(forecast), F.col(realised), F.col(anchor)
    d = long.filter(f.isNotNull() & r.isNotNull() & a.isNotNull())
    # nine decimals: arithmetic noise must not break ties between equal changes
    d = d.withColumn("_df", F.round(f - a, 9)).withColumn("_dr", F.round(r - a, 9))
    d = d.withColumns({"_rf": C.avg_rank("_df", *keys), "_rr": C.avg_rank("_dr", *keys)})
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(f - r)).alias("mae_m"), F.avg(F.abs(a - r)).alias("mae_n"), C.pearson("_rf", "_rr").alias("ic")
    )
    skill = F.when(F.col("mae_n") > 1e-12, 1.0 - F.col("mae_m") / F.col("mae_n"))
    return g.filter(F.col("n") >= min_n).withColumn("skill", skill)


def tally_class(sign: Column, pit: Column) -> Column:
    """supportive / against / middle / mixed by textbook sign and latest percentile; NULL when no percentile exists."""
    high, low = pit >= 2 / 3, pit <= 1 / 3
    return (
        F.when(sign == 0, "mixed")
        .when(pit.isNull(), None)
        .when((high & (sign > 0)) | (low & (sign < 0)), "supportive")
        .when((high & (sign < 0)) | (low & (sign > 0)), "against")
        .otherwise("middle")
    )


#: Horizon in rows, rows between refits, rows a fit needs, strength of the ridge; inputs may start so many months late, and so many must remain.
H, STEP, MIN_ROWS, ALPHA = 12, 3, 60, 50.0
LATE_MONTHS, LEAST_INPUTS = 72, 3


def input_table(df: DataFrame, inputs, keys=("entity",), month: str = "month") -> DataFrame:
    """(keys, input, first, used): an input is used unless it is empty or starts later than the rest of the history can bear."""
    long = df.select(*keys, month, F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("x")) for c in inputs])).alias("o")).select(*keys, month, "o.*")
    g = long.groupBy(*keys, "input").agg(F.min(month).alias("_start"), F.min(F.when(F.col("x").isNotNull(), F.col(month))).alias("first"))
    return g.withColumn("used", F.coalesce(F.col("first") <= F.add_months("_start", LATE_MONTHS), F.lit(False))).drop("_start")


def chosen_inputs(df: DataFrame, inputs, keys=("entity",), month: str = "month") -> DataFrame:
    """`df` with the inputs that a key does not use set to 0 (a constant has no part in a standardised fit); keys with too few are left out.

    So keys with different inputs are solved by one system of equal size each.
    """
    own = input_table(df, inputs, keys, month).filter("used").groupBy(*keys).agg(F.collect_set("input").alias("_used"))
    own = own.filter(F.size("_used") >= LEAST_INPUTS)
    masked = {c: F.when(F.array_contains("_used", c), F.col(c)).otherwise(0.0) for c in inputs}
    return df.join(own, list(keys)).withColumns(masked).drop("_used")


def expanding_forecast(rows: DataFrame, inputs, y: str, keys, h: int = H, step: int = STEP, min_rows: int = MIN_ROWS, alpha: float = ALPHA) -> DataFrame:
    """Forecast of y, known h rows later, by a ridge that is refitted every `step` rows on rows whose outcome was known by then.

    The first refit comes min_rows + h rows behind the first complete row; (keys, pos, fold, n_train, pred).
    """
    keys = list(keys)
    whole = F.lit(True)
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    every = Window.partitionBy(*keys)
    pos, first = F.col("pos"), F.min(F.when(whole, F.col("pos"))).over(every) + min_rows + h
    d = rows.withColumns({"_whole": whole, "_first": first, "_n": F.max("pos").over(every) + 1}).filter("_whole and _first < _n")
    known = F.col(y).isNotNull()
    folds = F.filter(F.sequence(F.col("_first"), F.col("_n") - 1, F.lit(step)), lambda s: (known & (pos <= s - h)) | ((pos >= s) & (pos < s + step)))
    d = d.withColumn("fold", F.explode(folds)).withColumns({"learn": pos < F.col("fold"), "graded": pos >= F.col("fold"), "yk": F.col(y)})
    fits = Q.ridge_fits(d, inputs, [*keys, "fold"], alpha, min_rows)
    scored = d.filter("graded").join(fits, [*keys, "fold"])
    return scored.withColumn("pred", SV.linear(F.col("coef"), inputs)).drop("_whole", "_first", "_n", "coef", "learn", "graded", "yk")
