"""Look-ahead, entity independence, row order and planted-signal properties of the point-in-time operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions import columns as C
from pitpanel.operators import align as AL
from pitpanel.operators import analogue as N
from pitpanel.operators import boosting as BO
from pitpanel.operators import forest as FO
from pitpanel.operators import order as O
from pitpanel.operators import quantile as Q
from pitpanel.operators import solve as SV
from pitpanel.operators import states as S
from pitpanel.operators import targets as T
from pitpanel.sources import views as V

FEATS = ("a", "b", "c")


def panel(n=90, entities=("e1", "e2"), seed=3, signal=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for e in entities:
        x = rng.normal(size=(n, 3))
        step = 0.02 * rng.normal(size=n) + 0.02 * signal * np.r_[0.0, x[:-1, 0]]
        px = 100 * np.exp(np.cumsum(step))
        out.append(pd.DataFrame({"entity": e, "pos": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "px": px}))
    return pd.concat(out, ignore_index=True)


def frame(spark, pdf, h=3):
    df = spark.createDataFrame(pdf).withColumn("pos", F.col("pos").cast("int"))
    df = df.withColumn("month", F.last_day(F.add_months(F.lit("2000-01-31").cast("date"), F.col("pos"))))
    df = df.withColumn("y", C.forward_return("px", h, C.by_entity("entity")))
    return T.split3(df, "y", h, 0.6, 0.2)


def wf_rules(df):
    df = df.withColumn("c1", F.lit(50)).withColumn("n_all", F.lit(90))
    fl = T.fold_rows(T.long_form(df, FEATS, ("entity", "month", "pos", "y", "c1", "n_all")), 3, 6)
    sc = S.run_rules(fl, ["entity", "fold"], 3, S.RuleConfig(threshold=1.0), ("y", "learn"))[3]
    return sc.filter(F.col("pos") >= F.col("fold")).select("entity", "pos", "score", "verdict")


def expanding(df):
    fl = T.long_form(df, FEATS, ("entity", "pos"))
    return O.expanding_percentile(fl, "x", ["entity", "feature"], "p", 12).select("entity", "pos", "feature", "p")


def ridge(df):
    return SV.walk_forward_ridge(df, FEATS, "y", 3, 3, 40, 30, 50.0).select("entity", "pos", F.round("pred", 9).alias("pred"))


def horizons(df):
    n = F.max("pos").over(Window.partitionBy("entity")) + 1
    return Q.refit_rows(Q.horizon_rows(df.withColumns({"c1": F.lit(50), "n_all": n}), "px", grid=(1, 3)))


def ridge_fan(df):
    out = Q.ridge_quantiles(horizons(df), FEATS)
    return out.select("entity", "pos", "horizon", *[F.round(F.get("qm", F.lit(i)), 9).alias(f"q{i}") for i in range(5)])


def boost_fan(df):
    out = BO.fold_quantiles(horizons(df), FEATS, Q.LEVELS, ("entity", "horizon"), rounds=5)
    return out.select("entity", "pos", "horizon", *[F.round(F.get("q", F.lit(i)), 9).alias(f"q{i}") for i in range(5)])


def refits(df):
    n = F.max("pos").over(Window.partitionBy("entity")) + 1
    rows = T.fold_rows(df.withColumns({"c1": F.lit(50), "n_all": n.cast("int")}), 3, 6)
    return rows.withColumn("graded", F.col("pos") >= F.col("fold")).filter("learn or graded")


def logit(df):
    return SV.fold_logit(refits(df), FEATS, ["entity", "fold"]).select("entity", "pos", F.round("p", 7).alias("p"))


def forest(df):
    return FO.fold_forest(refits(df), FEATS, trees=20).select("entity", "pos", F.round("p", 9).alias("p"))


def boosting(df):
    return BO.fold_classifier(refits(df), FEATS, rounds=10).select("entity", "pos", F.round("p", 9).alias("p"))


def analogues(df):
    return N.walk_forward(df.withColumn("c1", F.lit(50)), FEATS, 3, k=5, carry=()).select("entity", "pos", "med", "pos_share")


def history(df):
    h = Q.history_quantiles(df.withColumn("c1", F.lit(50)), "px")
    return h.select("entity", "pos", "horizon", *[F.get("qb", F.lit(i)).alias(f"b{i}") for i in range(5)])


def price_features(df):
    w = C.by_entity("entity")
    d = df.withColumn("px_r1", C.pct_change("px", 1, w))
    return d.select("entity", "pos", *[c.alias(k) for k, c in Q.price_features("px", w).items()])


POINT_IN_TIME = [wf_rules, expanding, ridge, ridge_fan, boost_fan, logit, forest, boosting, analogues, history, price_features]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("op", POINT_IN_TIME)
def test_no_look_ahead(spark, op):
    """Results up to row t do not change when later rows are altered."""
    t = 70
    base = panel()
    changed = base.copy()
    late = changed["pos"] > t
    changed.loc[late, ["a", "b", "c"]] = changed.loc[late, ["a", "b", "c"]] * -3 + 1
    changed.loc[late, "px"] = changed.loc[late, "px"] * 5
    before = lambda p: rows(op(frame(spark, p)).filter(F.col("pos") <= t))
    got = before(base)
    assert got and got == before(changed)


@pytest.mark.parametrize("op", [wf_rules, ridge, forest, boost_fan, analogues, history])
def test_entities_are_independent(spark, op):
    both = panel()
    alone = both[both.entity == "e1"]
    assert rows(op(frame(spark, both)).filter("entity = 'e1'")) == rows(op(frame(spark, alone)))


@pytest.mark.parametrize("op", [wf_rules, expanding, ridge, analogues])
def test_row_order_does_not_matter(spark, op):
    p = panel()
    mixed = frame(spark, p.sample(frac=1.0, random_state=1)).repartition(5)
    assert rows(op(frame(spark, p))) == rows(op(mixed))


def test_planted_signal_and_noise(spark):
    def stats(signal):
        df = frame(spark, panel(240, ("e1",), seed=11, signal=signal))
        fl = T.long_form(df, FEATS, ("entity", "pos", "y", "part")).withColumn("learn", F.col("y").isNotNull())
        st = S.tercile_states(fl, ["entity", "feature"], F.col("learn"))
        return S.bucket_stats(st.filter("learn"), ["entity"], 3).toPandas()

    strong = stats(1.5)
    best = strong.loc[strong.t.abs().idxmax()]
    assert best.feature == "a" and abs(best.t) > 4
    assert (stats(0.0).q <= 0.05).sum() <= 1


def test_availability_hides_later_observations(spark):
    obs = spark.createDataFrame(
        [("s", "2020-01-31", 1.0), ("s", "2020-02-29", 2.0), ("s", "2020-03-31", 3.0)], "series_id string, d string, value double"
    ).withColumn("obs_date", F.to_date("d"))
    out = AL.available(obs, ["series_id"], "obs_date", AL.lagged(F.col("obs_date"), 1, 0), "value").toPandas().sort_values("avail_date")
    assert [str(d) for d in out.avail_date] == ["2020-02-29", "2020-03-29", "2020-04-30"]
    assert list(out.value) == [1.0, 2.0, 3.0]


def test_dense_months_fills_gaps(spark):
    sparse = spark.createDataFrame([("e", "2020-01-31", 1.0), ("e", "2020-04-30", 4.0)], "entity string, m string, px double")
    out = V.dense_months(sparse.select("entity", F.to_date("m").alias("month"), "px")).orderBy("pos").collect()
    assert [(str(r.month), r.pos, r.px, r.filled) for r in out] == [
        ("2020-01-31", 0, 1.0, False), ("2020-02-29", 1, 1.0, True), ("2020-03-31", 2, 1.0, True), ("2020-04-30", 3, 4.0, False),
    ]
