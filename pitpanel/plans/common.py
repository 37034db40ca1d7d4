"""The feature frame most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import solve as SV
from ..operators import states as S
from ..operators import targets as T
from ..sources import views as V
from ..sources.store import materialise

CFG = S.RuleConfig(by="t", threshold=1.0)
STEP = 6


def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel plus six indicators and the h-month forward return of the price."""
    w = C.by_entity("entity")
    return (
        V.monthly_panel(spark, sf_dir)
        .withColumns(
            {
                "ret_d3": C.stable(C.diff("ret", 3, w)),
                "qty_c3": C.stable(C.pct_change("qty", 3, w)),
                "px_m6": C.stable(C.pct_change("px", 6, w)),
                "px_t10": C.stable(C.ratio("px", C.rolling(F.avg, "px", 10, 10, w)) - 1.0),
                "y": C.forward_return("px", V.H, w),
            }
        )
    )


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-case rows with the purged three-way split, computed once per session and input version."""

    def build() -> DataFrame:
        full = T.complete_case(features_all(spark, sf_dir), V.FEATURES)
        return T.split3(full, "y", V.H, V.TRAIN, V.VAL)

    return materialise(spark, sf_dir, "features", V.PANEL_TABLES, build)


def fold_frame(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    """The feature frame once per refit: `learn` rows were known then, `graded` ones are the next `step`."""
    rows = T.fold_rows(feature_frame(spark, sf_dir), V.H, step)
    return rows.withColumn("graded", F.col("pos") >= F.col("fold")).filter("learn or graded")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward probability and base rate of the logistic classifier, for every row from the validation start on."""
    build = lambda: SV.fold_logit(fold_frame(spark, sf_dir), V.FEATURES, ["entity", "fold"]).withColumn("p", C.stable("p", 9))
    return materialise(spark, sf_dir, "wf_logit", V.PANEL_TABLES, build)


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    fw = feature_frame(spark, sf_dir)
    return T.long_form(fw, V.FEATURES, ("entity", "month", "pos", "y", "part", "c1", "n_all"))


CARRY = ("month", "y", "learn", "part")


def _fitted(spark: SparkSession, sf_dir: str, name: str, long: DataFrame, keys):
    """(states, statistics, rules, scored rows); the statistics table is small, read by several steps and kept."""
    st = S.tercile_states(long, [*keys, "feature"], F.col("learn"))
    bs = materialise(spark, sf_dir, name, V.PANEL_TABLES, lambda: S.bucket_stats(st.filter("learn"), keys, V.H))
    rules = S.select_rules(bs, CFG)
    return st, bs, rules, S.verdicts(S.rule_scores(st, rules, keys, CARRY), keys, F.col("learn"))


def learned(spark: SparkSession, sf_dir: str):
    """Single fit on the learn rows."""
    fl = feature_long(spark, sf_dir).withColumn("learn", F.col("part") == "learn")
    return _fitted(spark, sf_dir, "stats", fl, ["entity"])


def refit(spark: SparkSession, sf_dir: str):
    """Walk-forward: every refit of every entity in one job."""
    fl = T.fold_rows(feature_long(spark, sf_dir), V.H, STEP)
    return _fitted(spark, sf_dir, "fold_stats", fl, ["entity", "fold"])


def enough(df: DataFrame, keys, need: int = 36) -> DataFrame:
    """Keys whose learn window is long enough."""
    from pyspark.sql import Window

    n = F.count(F.when(F.col("learn"), 1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.col("_n") >= need).drop("_n")
