"""Trees, boosting, order statistics, searches and fills against plain versions of the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import align as AL
from pitpanel.operators import analogue as N
from pitpanel.operators import boosting as BO
from pitpanel.operators import expect as X
from pitpanel.operators import forest as FO
from pitpanel.operators import order as O
from pitpanel.operators import quantile as Q
from pitpanel.operators import trees as TR


# --------------------------------------------------------------------------- trees
def plain_split(bins, weight, value, min_leaf, features):
    best = (0.0, -1, 0)
    for f in features:
        for cut in range(bins[:, f].max()):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            a, b = weight[left].sum(), weight[~left].sum()
            gain = round(a * b / (a + b) * (np.average(value[left], weights=weight[left]) - np.average(value[~left], weights=weight[~left])) ** 2, 10)
            if gain > best[0]:
                best = (gain, f, cut)
    return best


@pytest.fixture
def folds():
    """Three folds of one key with rows of their own, as flat arrays."""
    rng = np.random.default_rng(4)
    fold = np.repeat([0, 1, 2], [60, 75, 90])
    pos = np.concatenate([np.arange(n) for n in (60, 75, 90)])
    bins = rng.integers(0, 8, size=(len(fold), 5))
    learn = np.concatenate([np.arange(n) < n - 10 for n in (60, 75, 90)])
    y = bins[:, 1] * 0.3 - (bins[:, 3] > 4) + rng.normal(size=len(fold))
    return fold, pos, bins, learn, y


def test_forest_equals_trees_grown_one_by_one(folds):
    fold, pos, bins, learn, y = folds
    label, tree, depth, nodes = (y > 0) * 1.0, np.arange(6), 3, 8
    share, gains = FO.grow(bins, fold, pos, label, learn, tree, depth, 4, 2)
    want, shares = np.zeros(len(fold)), np.zeros((6, 3, 5))
    for t in tree:
        for g in range(3):
            rows = np.flatnonzero(fold == g)
            w = FO.copies(np.array([t]), pos[rows], 0)[0] * learn[rows]

            def grow(own, level, number, t=t, g=g, rows=rows, w=w):
                used = own[w[np.searchsorted(rows, own)] > 0]
                if level < depth:
                    some = np.flatnonzero(FO.tried(tree, nodes, 5, 2, 1 + level)[t, number])
                    gain, f, cut = plain_split(bins[used], w[np.searchsorted(rows, used)].astype(float), label[used], 4, some)
                    if f >= 0:
                        shares[t, g, f] += gain
                        go = bins[own, f] <= cut
                        grow(own[go], level + 1, 2 * number)
                        grow(own[~go], level + 1, 2 * number + 1)
                    else:
                        grow(own, level + 1, 2 * number)
                else:
                    want[own] += np.average(label[used], weights=w[np.searchsorted(rows, used)])

            grow(rows, 0, 0)
    assert np.allclose(share, want)
    total = shares.sum(2, keepdims=True)
    assert np.allclose(gains, shares / np.where(total > 0, total, 1))
    assert np.allclose(gains.sum(2), 1)


def plain_boost(bins, fold, pos, y, learn, tau, rounds, rate, min_leaf):
    """One fold, one level (or classes where tau is null), leaves by masks."""
    raw = np.full(len(y), np.quantile(y[learn], tau) if tau is not None else np.log(y[learn].mean() / (1 - y[learn].mean())))
    for number in range(rounds):
        used = BO.drawn(fold, pos, learn, 0.8, number, 0)
        p = 1 / (1 + np.exp(-raw))
        gradient = np.where(y > raw, tau, tau - 1) if tau is not None else y - p
        leaf = np.zeros(len(y), int)
        for _ in range(2):
            deeper = leaf * 2
            for node in np.unique(leaf):
                own = leaf == node
                _, f, cut = plain_split(bins[own & used], np.ones((own & used).sum()), gradient[own & used], min_leaf, range(bins.shape[1]))
                if f >= 0:
                    deeper[own] += bins[own, f] > cut
            leaf = deeper
        for node in np.unique(leaf):
            own = leaf == node
            inside = own & used
            step = np.quantile((y - raw)[inside], tau) if tau is not None else gradient[inside].sum() / (p * (1 - p))[inside].sum()
            raw = np.where(own, raw + rate * step, raw)
    return raw


@pytest.mark.parametrize("levels", [Q.LEVELS, None])
def test_boosting_equals_models_fitted_one_by_one(folds, levels):
    fold, pos, bins, learn, y = folds
    target = y if levels else (y > 0) * 1.0
    got = BO.boost(bins, fold, pos, np.where(learn, target, np.nan), learn, levels, 12, 0.1, 2, 0.8, np.array([5, 6, 7]))
    for g in range(3):
        own = fold == g
        for i, tau in enumerate(levels or [None]):
            want = plain_boost(bins[own], np.zeros(own.sum(), int), pos[own], target[own], learn[own], tau, 12, 0.1, 5 + g)
            assert np.allclose(got[i, own], want, atol=1e-9)


def test_group_quantiles():
    rng = np.random.default_rng(0)
    group, values = rng.integers(0, 5, 200), rng.normal(size=200)
    group[group == 3] = 2
    got = TR.group_quantiles(values, group, np.array([0.1, 0.5, 0.9, 0.5, 0.25]))
    want = [np.quantile(values[group == g], q) if (group == g).any() else 0 for g, q in enumerate((0.1, 0.5, 0.9, 0.5, 0.25))]
    assert np.allclose(got, want)


def test_importances_sum_to_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    pdf = pd.DataFrame({"entity": "e", "fold": 0, "pos": np.arange(120), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": x[:, 1] + 0.2 * rng.normal(size=120), "learn": True})
    out = FO.importances(spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("int") for c in ("fold", "pos")}), ("a", "b", "c"), trees=50).toPandas()
    assert out.importance.sum() == pytest.approx(1) and out.set_index("feature").importance.idxmax() == "b"


# --------------------------------------------------------------------------- order statistics
def test_expanding_percentile_with_ties_and_gaps(spark):
    rng = np.random.default_rng(6)
    rows = [(k, p, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for k in "ab" for p in range(101)]
    df = spark.createDataFrame(rows, "k string, pos int, x double").repartition(4)
    got = {(r["k"], r["pos"]): r["p"] for r in O.expanding_percentile(df, "x", ["k"], "p", 5).collect()}
    for k, p, x in rows:
        past = [v for kk, q, v in rows if kk == k and q < p and v is not None]
        want = None if x is None or len(past) < 4 else sum(v < x for v in past) / len(past)
        assert got[k, p] == (pytest.approx(want) if want is not None else None)


def test_order_statistics(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 20, 90).astype(float)
    values = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, pos int, v double")
    asked = [(upto, j) for upto in (0, 5, 40, 89) for j in range(0, upto + 1, max(1, upto // 7))]
    asks = spark.createDataFrame([("k", i, upto, j, upto + 1) for i, (upto, j) in enumerate(asked)], "k string, ask int, upto int, j int, n int")
    got = {r["ask"]: r["v"] for r in O.order_statistics(values, asks, ["k"], 7).collect()}
    assert [got[i] for i in range(len(asked))] == [np.sort(v[: upto + 1])[j] for upto, j in asked]


def test_history_of_a_long_key(spark):
    """Ten thousand rows of one key: every refit's quantiles are exact, without a stored history."""
    n, rng = 10_000, np.random.default_rng(8)
    px = np.exp(np.cumsum(0.01 * rng.normal(size=n)))
    df = spark.createDataFrame(pd.DataFrame({"entity": "e", "pos": np.arange(n, dtype=np.int32), "px": px})).withColumn("c1", F.lit(100))
    out = Q.history_quantiles(df, "px", step=1000, grid=(1, 24)).filter("pos = fold").toPandas()
    assert len(out) == 20
    for r in out.itertuples():
        known = np.log(px[r.horizon : r.fold + 1] / px[: r.fold + 1 - r.horizon])
        assert np.allclose(r.qb, np.quantile(known, Q.LEVELS))


def test_percentiles_of_a_long_key(spark):
    n, rng = 10_000, np.random.default_rng(9)
    x = rng.normal(size=n).round(2)
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "pos": np.arange(n, dtype=np.int32), "x": x}))
    got = O.expanding_percentile(df, "x", ["k"], "p").orderBy("pos").toPandas()["p"].to_numpy()
    assert all(got[i] == pytest.approx((x[:i] < x[i]).mean()) for i in rng.integers(40, n, 200))


# --------------------------------------------------------------------------- searches and fills
def test_blocked_search_equals_the_full_one():
    rng = np.random.default_rng(10)
    n, k, gap, h = 700, 6, 4, 3
    pos = np.sort(rng.integers(0, 500, n))  # positions repeat
    x, y = np.cumsum(rng.normal(size=(n, 3)), axis=0).round(1), np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
    scale = np.abs(rng.normal(size=(n, 3))) + 0.5
    asks = np.arange(100, n, 7)
    got = N.search(x, pos, y, scale, asks, h, k, gap, block=16)
    for i, picks in zip(asks, got, strict=True):
        db = [j for j in range(i - h + 1) if not np.isnan(y[j])]
        d = {j: round(float(np.sqrt((((x[j] - x[i]) / scale[i]) ** 2).sum())), 12) for j in db}
        want = []
        for j in sorted(db, key=lambda j: (d[j], pos[j], y[j])):
            if len(want) < k and all(abs(pos[j] - pos[c]) >= gap for c in want):
                want.append(j)
        assert picks == want


def test_fill_by_blocks(spark):
    rng = np.random.default_rng(11)
    days = pd.date_range("2019-12-20", periods=400).delete(slice(100, 250))
    pdf = pd.DataFrame({"d": days.date, "a": np.where(rng.random(250) < 0.03, rng.normal(size=250), np.nan), "b": np.where(np.arange(250) == 3, 1.0, np.nan)})
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)], "d date, a double, b double").repartition(5)
    got = AL.fill_forward(df, ["a", "b"]).orderBy("d").toPandas()
    want = pdf[["a", "b"]].ffill()
    assert np.allclose(got[["a", "b"]].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_inputs_are_chosen_per_key(spark):
    rows = [(e, i, f"2000-01-{1 + i % 28:02d}", float(i), None if e == "x" or i < 3 else 2.0, None, 1.0 if e == "x" else None) for e in "xy" for i in range(5)]
    df = spark.createDataFrame(rows, "entity string, pos int, m string, a double, b double, c double, d double").withColumn("month", F.to_date("m"))
    used = {(r["entity"], r["input"]) for r in X.input_table(df, ("a", "b", "c", "d", "pos")).filter("used").collect()}
    assert used == {("x", "a"), ("x", "d"), ("x", "pos"), ("y", "a"), ("y", "b"), ("y", "pos")}
    out = X.chosen_inputs(df, ("a", "b", "c", "d")).collect()
    assert out == []  # two inputs are too few
