"""States of an indicator, what followed them, and the rules and verdicts built on that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import stats

STATES = ("Low", "Mid", "High")
FAV, NEU, UNF = "Favorable", "Neutral", "Unfavorable"


@dataclass(frozen=True)
class RuleConfig:
    by: str = "t"  # "t": |t| >= threshold, "q": q <= threshold
    threshold: float = 1.5
    consistent: bool = False
    weighting: str = "equal"  # or "t": clip(|t| - 1, 0, 3)


def three_way(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNull(), None).when(x <= lo, "Low").when(x <= hi, "Mid").otherwise("High")


def tercile_states(df: DataFrame, keys, learn: Column, x: str = "x", state: str = "state") -> DataFrame:
    """Low / Mid / High by the exact 1/3 and 2/3 quantiles of the learn rows of each key."""
    cuts = F.percentile(F.when(learn, F.col(x)), [1 / 3, 2 / 3]).over(C.whole(*keys))
    out = df.withColumn("_cuts", cuts).withColumn("lo", F.get("_cuts", F.lit(0))).withColumn("hi", F.get("_cuts", F.lit(1)))
    # a cut interpolated between two equal values may be off by one bit, hence `stable` on both sides
    return out.withColumn(state, three_way(*[C.stable(c) for c in (x, "lo", "hi")])).drop("_cuts")


def percentile_state(p: str | Column) -> Column:
    return three_way(C.col(p), F.lit(1 / 3), F.lit(2 / 3))


def bucket_stats(learn: DataFrame, keys, h: int | str, min_n: int = 8, most: int | None = None) -> DataFrame:
    """Per feature and state: n, mean, median, share positive, edge, HAC t (over h lags, or a key column of up to `most`), consistency, p and BH q.

    `learn` holds one row per (keys, feature, pos) with its state and outcome y.
    """
    g = [*keys, "feature"]
    half = F.row_number().over(Window.partitionBy(*g).orderBy("pos")) > F.floor(F.count(F.lit(1)).over(C.whole(*g)) / 2)
    rows = learn.select(*g, "pos", "y", F.col("state").alias("own"), half.alias("second"))
    rows = rows.withColumn("state", F.explode(F.array(*[F.lit(s) for s in STATES])))
    rows = rows.withColumn("d", F.coalesce((F.col("own") == F.col("state")).cast("double"), F.lit(0.0)))
    hit, y = F.col("d") == 1, F.col("y")

    def half_edge(which: Column) -> Column:
        inside = F.when(hit & which, y)
        return F.when(F.count(inside) >= 4, F.avg(inside) - F.avg(F.when(which, y)))

    r = F.when(hit, y)
    t = stats.hac_t(
        rows,
        [*g, "state"],
        "y",
        "d",
        h,
        extra=(
            F.count(r).alias("n"),
            F.avg(r).alias("avg"),
            F.percentile(r, 0.5).alias("median"),
            F.avg((r > 0).cast("double")).alias("win"),
            (F.avg(r) - F.avg(y)).alias("edge"),
            half_edge(~F.col("second")).alias("_e1"),
            half_edge(F.col("second")).alias("_e2"),
        ),
        most=most,
    ).filter(F.col("n") >= min_n)
    sign = lambda c: F.signum(F.round(c, 12))
    same = (sign(F.col("_e1")) == sign(F.col("_e2"))) & (sign(F.col("_e2")) == sign(F.col("edge")))
    t = t.withColumn("consistent", F.coalesce(same, F.lit(False))).withColumn("p", C.two_sided_p("t"))
    return stats.bh_q(t, keys, "p", ("feature", "state")).drop("_e1", "_e2")


def select_rules(bs: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Rules that pass the strength filter, as one signed weight each."""
    ok = F.abs("t") >= cfg.threshold if cfg.by == "t" else F.col("q") <= cfg.threshold
    if cfg.consistent:
        ok = ok & F.col("consistent")
    size = F.lit(1.0) if cfg.weighting == "equal" else C.clip(F.abs("t") - 1.0, 0.0, 3.0)
    edge = F.round("edge", 12)
    return bs.filter(ok & (edge != 0)).withColumn("weight", F.signum(edge) * size)


def rule_scores(states: DataFrame, rules: DataFrame, keys, carry) -> DataFrame:
    """Sum of signed weights of the states that hold, per row (0 when none does)."""
    on = [*keys, "feature", "state"]
    joined = states.join(rules.select(*on, "weight"), on, "left")
    same = [F.first(c).alias(c) for c in carry]  # equal on every feature row of the same pos
    return joined.groupBy(*keys, "pos").agg(*same, F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))


def verdict_of(score: Column, lo: Column, hi: Column) -> Column:
    return F.when((score <= lo) & (score < 0), UNF).when((score >= hi) & (score > 0), FAV).otherwise(NEU)


def verdicts(scores: DataFrame, keys, learn: Column) -> DataFrame:
    """Favorable / Neutral / Unfavorable by the quartiles of the learn scores."""
    q = F.percentile(F.when(learn, F.col("score")), [0.25, 0.75]).over(C.whole(*keys))
    out = scores.withColumn("_q", q)
    return out.withColumn("verdict", verdict_of(F.col("score"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_q")


def run_rules(long: DataFrame, keys, h: int | str, cfg: RuleConfig, carry=("month", "y", "learn"), most: int | None = None):
    """States, statistics, rules, scores and verdicts in one declarative chain.

    With `fold` among the keys, every refit is estimated in the same job.
    """
    st = tercile_states(long, [*keys, "feature"], F.col("learn"))
    bs = bucket_stats(st.filter("learn"), keys, h, most=most)
    rules = select_rules(bs, cfg)
    sc = verdicts(rule_scores(st, rules, keys, carry), keys, F.col("learn"))
    return st, bs, rules, sc


def favorable_spread(df: DataFrame, keys, y: str = "y", v: str = "verdict", min_n: int = 3) -> DataFrame:
    """Mean outcome after Favorable minus after Unfavorable, in points."""
    fav, unf = F.when(F.col(v) == FAV, F.col(y)), F.when(F.col(v) == UNF, F.col(y))
    ok = (F.count(fav) >= min_n) & (F.count(unf) >= min_n)
    return df.groupBy(*keys).agg(
        F.count(fav).alias("n_fav"),
        F.count(unf).alias("n_unf"),
        F.when(ok, (F.avg(fav) - F.avg(unf)) * 100).alias("spread"),
    )
