"""Small hand-made cases, checked against independent numpy derivations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import arrays as A
from pitpanel.functions import columns as C
from pitpanel.operators import align as AL
from pitpanel.operators import backtest as B
from pitpanel.operators import calendar as K
from pitpanel.operators import expect as X
from pitpanel.operators import factors as FA
from pitpanel.operators import model as M
from pitpanel.operators import order as O
from pitpanel.operators import quantile as Q
from pitpanel.operators import report as RP
from pitpanel.operators import solve as SV
from pitpanel.operators import states as S
from pitpanel.operators import stats as ST
from pitpanel.operators import targets as T
from pitpanel.sources import landed as L
from pitpanel.sources import store


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_clip_and_ratio_keep_null(spark):
    r = one(
        spark, C.clip(F.lit(None).cast("double"), -1, 1).alias("a"), C.clip(F.lit(5.0), -1, 1).alias("b"), C.ratio(F.lit(1.0), F.lit(0.0)).alias("c"),
        C.finite(F.lit(float("inf"))).alias("d"), C.finite(F.lit(float("nan"))).alias("e"),
        C.row_mean(F.lit(None).cast("double"), F.lit(2.0), F.lit(4.0)).alias("f"), C.row_mean(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("g"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (None, 1.0, None, None, None, 3.0, None)


def test_normal_cdf(spark):
    zs = np.linspace(-4, 4, 33)
    got = spark.createDataFrame([(float(z),) for z in zs], "z double").select("z", C.normal_cdf(F.col("z")).alias("p")).toPandas()
    want = [0.5 * math.erfc(-z / math.sqrt(2)) for z in got.z]
    assert np.abs(got.p - want).max() < 2e-7


@pytest.mark.parametrize("kind", ["binary", "real", "constant"])
def test_hac_t_matches_pseudo_inverse(spark, kind):
    rng = np.random.default_rng(5)
    n, lags = 60, 4
    y = rng.normal(size=n)
    d = {"binary": (rng.random(n) < 0.4) * 1.0, "real": rng.normal(size=n), "constant": np.full(n, 2.0)}[kind]
    x = np.column_stack([np.ones(n), d])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    m = x * (y - x @ beta)[:, None]
    cov = m.T @ m + sum((1 - k / (lags + 1)) * (m[k:].T @ m[:-k] + m[:-k].T @ m[k:]) for k in range(1, lags + 1))
    want = beta[1] / np.sqrt((inv @ cov @ inv)[1, 1])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": range(n), "y": y, "d": d}))
    assert ST.hac_t(df, ["k"], "y", "d", lags).first().t == pytest.approx(want, rel=1e-9)


def test_bh_q(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(1, v) for v in p], "k int, p double")
    got = {r.p: r.q for r in ST.bh_q(df, ["k"]).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5


def test_rank_ic_guards(spark):
    df = spark.createDataFrame([("few", float(i), float(i)) for i in range(7)] + [("flat", 1.0, float(i)) for i in range(9)]
                               + [("up", float(i // 2), float(i)) for i in range(10)], "k string, x double, y double")
    got = {r.k: r.ic for r in ST.rank_ic(df, ["k"], "x", "y").collect()}
    assert got["few"] is None and got["flat"] is None
    want = pd.Series([i // 2 for i in range(10)]).rank().corr(pd.Series(range(10)).rank())
    assert got["up"] == pytest.approx(want)


def test_rolling_rank_ic(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, 30).astype(float), rng.normal(size=30)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": range(30), "x": x, "y": y}))
    got = ST.rolling_rank_ic(df, ["k"], "x", "y", 12).orderBy("pos").toPandas()
    assert got.ic[:11].isna().all()
    for i in (11, 20, 29):
        a, b = pd.Series(x[i - 11 : i + 1]), pd.Series(y[i - 11 : i + 1])
        assert got.ic[i] == pytest.approx(a.rank().corr(b.rank()))


def test_uniform_int_matches_numpy_blocks(spark):
    starts, length = ST.block_starts(23, 4, 5, seed=2)
    df = spark.range(5).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    got = df.select("id", "i", A.uniform_int(F.lit(20), F.col("id"), F.col("i"), 2).alias("s")).collect()
    assert {(r.id, r.i): r.s for r in got} == {(r, i): starts[r, i] for r in range(5) for i in range(6)}
    assert list(length) == [4, 4, 4, 4, 4, 3]


def test_block_ci_edges(spark):
    df = spark.createDataFrame([("few", i, 1.0 * i) for i in range(4)] + [("same", i, 2.0) for i in range(9)], "k string, pos int, y double")
    got = {r.k: r for r in ST.block_ci(df, ["k"], "y", 3, 100).collect()}
    assert got["few"].lo is None and got["same"].lo == got["same"].hi == pytest.approx(2.0)


def test_auc_ci_contains_auc_and_skips_one_class(spark):
    rng = np.random.default_rng(4)
    lab = (rng.random(80) < 0.5) * 1.0
    p = np.round(0.5 * lab + rng.random(80), 1)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(80), "p": p, "l": lab}))
    r = ST.auc_ci(df, ["k"], "p", "l", "i", 3, 200).first()
    auc = M.prob_metrics(df.select("k", "p", F.lit(0.5).alias("base"), (F.col("l") - 0.5).alias("y")), ["k"]).first().auc
    assert r.lo < auc < r.hi and r.reps == 200
    ones = df.withColumn("l", F.lit(1.0))
    r = ST.auc_ci(ones, ["k"], "p", "l", "i", 3, 50).first()
    assert r.reps == 0 and r.lo is None


def test_states_at_cut_points(spark):
    xs = (1.0, 2.0, 2.0, 2.0, 3.0, 4.0, None)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, pos int, x double")
    got = sorted((str(r.x), r.state) for r in S.tercile_states(df, ["k"], F.lit(True)).collect())
    assert got == [("1.0", "Low"), ("2.0", "Low"), ("2.0", "Low"), ("2.0", "Low"), ("3.0", "High"), ("4.0", "High"), ("None", None)]


def test_expanding_percentile_start(spark):
    df = spark.createDataFrame([(1, i, float(i % 4)) for i in range(10)], "k int, pos int, x double")
    got = [r.p for r in O.expanding_percentile(df, "x", ["k"], "p", 4).orderBy("pos").collect()]
    assert got[:3] == [None] * 3 and got[3] == 1.0 and got[4] == 0.0 and got[5] == pytest.approx(2 / 5)


def test_forward_drawdown(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 12.0, 6.0, 9.0, 3.0])], "k int, pos int, px double")
    got = [r.dd for r in df.select("pos", T.forward_drawdown("px", 2, C.by_entity("k")).alias("dd")).orderBy("pos").collect()]
    assert got == [-0.5, -0.5, pytest.approx(3 / 9 - 1), None, None]


def test_holidays_and_release(spark):
    days = {"2021-07-05": True, "2021-07-04": False, "2021-12-31": True, "2020-06-19": False, "2023-06-19": True, "2024-05-27": True, "2024-11-28": True, "1985-01-21": False}
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = {r.d: r.h for r in df.select("d", K.is_holiday(F.to_date("d")).alias("h")).collect()}
    assert got == days
    r = one(spark, K.report_release(F.to_date(F.lit("2024-05-28"))).alias("late"), K.report_release(F.to_date(F.lit("2024-05-14"))).alias("normal"),
            K.contract_expiry(F.to_date(F.lit("2020-04-01"))).alias("x"))
    assert (r.late, r.normal, r.x) == (dt.date(2024, 6, 3), dt.date(2024, 5, 17), dt.date(2020, 4, 21))


def test_interpolation_limit(spark):
    df = spark.createDataFrame([("s", "2020-01-01", 0.0), ("s", "2020-01-21", 20.0)], "k string, d string, v double").withColumn("day", F.to_date("d"))
    got = {r.day.day: r.v for r in AL.interpolate_days(df.select("k", "day", "v"), ["k"], "day", "v").collect()}
    assert len(got) == 21 and got[6] == 5.0 and got[11] == 10.0 and got[12] is None and got[21] == 20.0


def test_performance_edges(spark):
    df = spark.createDataFrame(
        [("one", 0, 0.1, 0.0), ("wipe", 0, 0.5, 0.0), ("wipe", 1, -1.0, 0.0), ("wipe", 2, 0.5, 0.0), ("up", 0, 0.1, 0.0), ("up", 1, 0.2, 0.0)],
        "k string, pos int, ret double, rf double",
    )
    got = {r.k: r for r in B.performance(df, ["k"]).collect()}
    assert got["one"].cagr is None and got["one"].sharpe is None
    assert got["wipe"].cagr == -1.0 and got["wipe"].max_dd == -1.0
    assert got["up"].calmar is None and got["up"].sortino is None and got["up"].cagr == pytest.approx(1.32**6 - 1)


def test_portfolio_ignores_missing_return_at_zero_weight(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 1.0, None, 0.1, 0.01), (1, 1, 1.0, 0.0, 0.0, 0.05, 0.1, 0.01), (1, 2, 1.0, 0.0, 0.0, None, 0.1, 0.01)],
        "k int, pos int, wa double, wb double, wc double, ra double, rb double, rf double",
    )
    got = B.portfolio_return(df, ["k"], F.lit(100.0), F.lit(0.0)).orderBy("pos").collect()
    assert [(r.pos, r.turn, round(r.ret, 9)) for r in got] == [(0, 0.0, 0.01), (1, 1.0, 0.04)]


def test_shifted_sharpe_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 40
    pdf = pd.DataFrame({"k": 1, "pos": range(n), "wa": rng.choice([0, 0.5, 1.0], n), "wb": 0.0, "ra": rng.normal(0, 0.1, n), "rb": rng.normal(0, 0.1, n), "rf": 0.001})
    got = B.shifted_sharpe(spark.createDataFrame(pdf), ["k"], 5, 10.0, F.col("pos") >= 20, F.lit(0.0)).toPandas()
    for r in got.itertuples():
        wa = np.roll(pdf.wa.to_numpy(), r.shift)
        turn = np.abs(np.diff(wa, prepend=0.0))
        ret = (wa * pdf.ra + (1 - wa) * pdf.rf - turn * 10 / 1e4)[20:]
        assert r.null_sharpe == pytest.approx((ret - 0.001).mean() * 12 / (ret.std() * np.sqrt(12)), rel=1e-9)


def test_ridge_from_moments():
    rng = np.random.default_rng(1)
    x, y, alpha = rng.normal(size=(50, 3)) * [1, 5, 0.1] + 2, rng.normal(size=50), 7.0
    iu = np.triu_indices(3)
    moments = np.r_[50, y.sum(), x.sum(0), (x * y[:, None]).sum(0), (x.T @ x)[iu]][None, :]
    got = SV.ridge_from_moments(moments, 3, alpha)[0]
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got[1:4], b / x.std(0)) and got[0] == pytest.approx(y.mean() - (b / x.std(0) * x.mean(0)).sum())


def test_logistic_gradient_vanishes():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0) * 1.0
    z = np.column_stack([np.ones(80), (x - x.mean(0)) / x.std(0)])
    live = np.ones((2, 80))
    live[1, 50:] = 0  # a second, shorter fit in the same batch
    both = SV.newton(np.stack([z, z * live[1][:, None]]), np.stack([y, y]), live, 0.3)
    for w, n in zip(both, (80, 50), strict=True):
        p = 1 / (1 + np.exp(-z[:n] @ w))
        assert abs((p - y[:n]).sum()) < 1e-8 and np.abs(z[:n, 1:].T @ (p - y[:n]) + w[1:] / 0.3).max() < 1e-8 and w[1] > 0.5


def test_merge_groups_equals_member_pair_means():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 3))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.3 * rng.normal(size=200), base[:, 1], base[:, 1] * -1 + 0.2 * rng.normal(size=200), base[:, 2]])
    groups = FA.merge_groups(np.abs(pd.DataFrame(x).corr(method="spearman").to_numpy()), 0.6)
    assert groups == [[0, 1], [2, 3], [4]]


def test_quantile_curve_and_score(spark):
    knots = spark.createDataFrame([("e", 1, [0.1, 0.2]), ("e", 3, [0.3, 0.8])], "k string, horizon int, q array<double>")
    got = {r.month_ahead: [round(v, 9) for v in r.q] for r in Q.curve(knots, ["k"], 4).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.1, 0.2], 2: [0.2, 0.5], 3: [0.3, 0.8], 4: [0.3, 0.8]}
    r = one(spark, Q.pinball(F.lit(1.0), F.array(*[F.lit(v) for v in (0.0, 0.5, 1.0, 1.5, 2.0)])).alias("p"),
            Q.chance_positive(F.array(*[F.lit(v) for v in (-2.0, -1.0, 0.0, 1.0, 2.0)])).alias("c"))
    assert r.p == pytest.approx((0.1 + 0.125 + 0 + 0.125 + 0.1) / 5) and r.c == pytest.approx(0.5)


def test_calibration_merges_equal_edges(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0)] * 6 + [(1, 0.9, -1.0)] * 4, "k int, p double, y double")
    got = M.calibration(df, ["k"]).orderBy("bin").collect()
    assert sum(r.n for r in got) == 10 and {r.share for r in got} == {1.0, 0.0}


def test_option_summary(spark):
    rows = [("S", "call", 30, 100.0, 0.20, 1.0, 1.0, 1), ("S", "put", 30, 100.0, 0.24, 1.0, 2.0, 2), ("S", "put", 30, 90.0, 0.30, 1.0, 0.0, 3),
            ("S", "call", 30, 110.0, 0.18, 0.0, 0.0, 4), ("S", "call", 90, 100.0, 0.25, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "symbol string, type string, dte int, strike double, iv double, oi double, vol double, row_id int")
    r = RP.option_summary(df).first()
    assert (r.near_dte, r.far_dte, round(r.atm_near, 6), round(r.atm_far, 6)) == (30, 90, 22.0, 25.0)
    assert round(r.skew, 6) == 10.0 and r.wings == "puts richer" and r.shape == "normal" and r.pc_vol == 2.0


def test_evidence_and_confidence(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    r = one(
        spark, RP.evidence_level(*lit(3, 5, 5, 4.0, 0.2, 0.1)).alias("s"), RP.evidence_level(*lit(3, 5, 5, 4.0, 0.1, 0.2)).alias("w"),
        RP.evidence_level(*lit(3, 2, 5, 4.0, 0.1, 0.2)).alias("u"), RP.evidence_level(*lit(0, 9, 9, 4.0, 0.1, 0.0)).alias("n"),
        RP.confidence(*lit(1, 1, "Strong")).alias("h"), RP.confidence(*lit(1, -1, "Strong")).alias("l"),
    )
    assert (r.s, r.w, r.u, r.n, r.h, r.l) == ("Strong", "Weak", "Unknown", "None", "High", "Low")


def test_textbook_tally_needs_percentile(spark):
    r = one(spark, X.tally_class(F.lit(1), F.lit(None).cast("double")).alias("a"), X.tally_class(F.lit(0), F.lit(None).cast("double")).alias("b"),
            X.tally_class(F.lit(-1), F.lit(0.9)).alias("c"), X.tally_class(F.lit(-1), F.lit(0.1)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (None, "mixed", "against", "supportive")


def test_landed_files(spark, tmp_path):
    folder = tmp_path / "macro" / "series=GDP"
    folder.mkdir(parents=True)
    (folder / "page1.json").write_text('{"observations":[{"date":"2020-01-01","value":"1.5"},{"date":"2020-02-01","value":"."}]}')
    (folder / "page2.json").write_text('{"observations":[{"date":"2020-01-01","value":"2.5"},{"date":"2020-03-01","value":"nan"}]}')
    got = L.read_macro_json(spark, str(tmp_path / "macro")).collect()
    assert [(r.series_id, str(r.obs_date), r.value) for r in got] == [("GDP", "2020-01-01", 2.5)]
    assert L.read_two_column_csv(spark, str(tmp_path / "none.csv"), "x") is None
    csv = tmp_path / "u.csv"
    csv.write_text("date,value,extra\n2020-01-01,1,9\n2020-01-02,.,9\n2020-01-03,3,9\n")
    assert L.read_two_column_csv(spark, str(csv), "x").count() == 2
    with pytest.raises(ValueError):
        L.read_two_column_csv(spark, str(csv), "x", 20)


def test_append_log_keeps_last(spark, tmp_path):
    old = spark.createDataFrame([("2020-01-01", 1, 1.0), ("2020-01-02", 2, 2.0)], "d string, seq int, v double")
    new = spark.createDataFrame([("2020-01-02", 1, 5.0), ("2020-01-03", 2, 6.0)], "d string, seq int, v double")
    log = L.append_log(old, new, ["d"], "seq", ["v"])
    assert {r.d: r.v for r in log.collect()} == {"2020-01-01": 1.0, "2020-01-02": 5.0, "2020-01-03": 6.0}
    L.write_log(log, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 3


def test_store_notices_rewritten_tables(spark, tmp_path):
    path = str(tmp_path)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{path}/t.parquet")

    spark.range(3).write.parquet(f"{path}/t.parquet")
    get = lambda: store.materialise(spark, path, "x", ("t",), build).count()
    assert (get(), get(), len(calls)) == (3, 3, 1)
    import os

    spark.range(5).write.mode("overwrite").parquet(f"{path}/t.parquet")
    os.utime(f"{path}/t.parquet", (2e9, 2e9))
    assert (get(), len(calls)) == (5, 2)


def test_leaf_quantiles_keep_every_test_row(spark):
    """A leaf in which an entity was never trained takes the quantiles of all entities."""
    import __spark_entry__ as entry
    from pitpanel.plans import common as P

    sf = "/root/testdata/sf0.001"
    want = {(r.entity, r.month) for r in P.feature_frame(spark, sf).filter("part = 'test'").collect()}
    got = entry.queries()["leaf_quantiles"](spark, sf).collect()
    assert len(got) == len(want) and {(r.entity, r.month) for r in got} == want
    assert all(r.n and r.q2 is not None for r in got)


def test_horizon_scan_tries_all_horizons(spark):
    """Every entity has a row for each of the six look-aheads, with scores only where there are enough rows."""
    import __spark_entry__ as entry

    got = entry.queries()["horizon_scan"](spark, "/root/testdata/sf0.001").collect()
    by_entity = {}
    for r in got:
        by_entity.setdefault(r.entity, []).append(r.horizon)
        assert r.n_val >= 10 or (r.rules_ic is None and r.ml_ic is None)
    assert by_entity and all(sorted(v) == [1, 2, 3, 6, 9, 12] for v in by_entity.values())
