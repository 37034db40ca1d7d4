"""Quantile projection queries (group N)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import boosting as BO
from ..operators import quantile as Q
from ..operators import targets as T
from ..sources import views as V
from ..sources.store import materialise
from . import common as P
from .linear_sql import ridge_ctes, ridge_pred
from .registry import R, cte, query, sql
from .stats import CORR

PF = ("px_mom1", "px_mom3", "px_mom6", "px_mom12", "px_vol12", "px_trend", "px_dd12")
cte("pfx", "SELECT entity, month, " + ", ".join(f"px/lag(px,{k}) OVER w-1e0 AS px_mom{k}" for k in (1, 3, 6, 12)) + """, vol AS px_vol12,
 CASE WHEN count(px) OVER w10>=10 THEN px/avg(px) OVER w10-1e0 END AS px_trend, CASE WHEN count(px) OVER w12>=12 THEN px/max(px) OVER w12-1e0 END AS px_dd12 FROM r2
 WINDOW w AS (PARTITION BY entity ORDER BY pos), w10 AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "r2")


def with_price_features(df):
    w = C.by_entity("entity")
    d = df.withColumn("px_r1", C.pct_change("px", 1, w))
    return d.withColumns(Q.price_features("px", w))


@query("price_features", sql("SELECT entity, month, " + R(*PF) + " FROM pfx", "pfx"))
def price_features(spark, sf):
    return C.rounded(with_price_features(V.monthly_panel(spark, sf)).select("entity", "month", *PF))


@query("log_fwd", sql("SELECT entity, month, " + R(*[f"ln(lead(px,{k}) OVER w/px) AS y{k}" for k in (1, 3, 6, 12)]) + " FROM fw WINDOW w AS (PARTITION BY entity ORDER BY pos)", "fw"))
def log_fwd(spark, sf):
    w = C.by_entity("entity")
    return C.rounded(P.feature_frame(spark, sf).select("entity", "month", *[Q.log_forward("px", k, w).alias(f"y{k}") for k in (1, 3, 6, 12)]))


INPUTS = (*V.FEATURES, *PF)
_G = ",".join(map(str, Q.GRID))
_L = "[" + ",".join(map(str, Q.LEVELS)) + "]"


def projection_frame(spark, sf):
    """Rows with all indicators and price features, split like the feature frame; computed once per session and input version."""

    def build():
        return T.split3(T.complete_case(with_price_features(P.features_all(spark, sf)), INPUTS), "y", V.H, V.TRAIN, V.VAL)

    return materialise(spark, sf, "projection", V.PANEL_TABLES, build)


def outcomes(spark, sf):
    return Q.horizon_rows(projection_frame(spark, sf), "px")


cte("pj0", "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY entity ORDER BY pos)-1 AS INTEGER) AS pos) FROM fw0 JOIN pfx USING (entity, month) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in PF), "fw0", "pfx")
cte("pj", """SELECT f.*, CASE WHEN y IS NULL THEN 'unknown' WHEN pos < c1 - 3 THEN 'learn' WHEN pos >= c1 AND pos < c2 - 3 THEN 'val' WHEN pos >= c2 THEN 'test' ELSE 'purged' END AS part
 FROM (SELECT *, CAST(floor(n_ev*0.6e0) AS INTEGER) AS c1, CAST(floor(n_ev*(0.6e0+0.2e0)) AS INTEGER) AS c2 FROM
 (SELECT *, count(y) OVER (PARTITION BY entity) AS n_ev, CAST(count(*) OVER (PARTITION BY entity) AS INTEGER) AS n_all FROM pj0)) f""", "pj0", held=True)
cte("pjy", " UNION ALL ".join(f"SELECT *, {k} AS horizon, ln(lead(px,{k}) OVER (PARTITION BY entity ORDER BY pos)/px) AS yk FROM pj" for k in Q.GRID), "pj", held=True)
cte("pjf", f"""SELECT *, pos<fold AS learn, pos>=fold AS graded FROM (SELECT *, CAST(unnest(generate_series(c1, n_all-1, {Q.STEP})) AS INTEGER) AS fold FROM pjy)
 WHERE (pos<=fold-horizon AND yk IS NOT NULL) OR (pos>=fold AND pos<fold+{Q.STEP})""", "pjy", held=True)
cte("hqq", f"SELECT entity, horizon, fold, quantile_cont(yk, {_L}) AS qb FROM pjf WHERE learn GROUP BY 1,2,3 HAVING count(*)>={Q.MIN_ROWS}", "pjf", held=True)
cte("hq", "SELECT f.*, qb FROM pjf f JOIN hqq USING (entity, horizon, fold) WHERE graded", "pjf", "hqq", held=True)


def five(col, name):
    return [f"{col}[{i + 1}] AS {name}{i}" for i in range(5)]


def fives(col, name):
    return [F.get(col, F.lit(i)).alias(f"{name}{i}") for i in range(5)]


@query("history_quantiles", sql("SELECT entity, month, CAST(horizon AS INTEGER) AS horizon, " + R("yk", *five("qb", "b")) + " FROM hq", "hq"))
def history_quantiles(spark, sf):
    h = Q.history_quantiles(projection_frame(spark, sf), "px")
    return C.rounded(h.select("entity", "month", "horizon", "yk", *fives("qb", "b")))


def ridge_model(p: str, src: str, features, extra: str = "") -> str:
    """CTE `<p>`: graded rows of `src` with model (qm) and history (qb) quantiles."""
    ridge_ctes(p, src, "entity, horizon, fold", features, "yk", Q.ALPHA, Q.MIN_ROWS)
    cte(f"{p}_x", f"SELECT x.*, {ridge_pred(features)} AS pred FROM {src} x JOIN {p}_fit USING (entity, horizon, fold)", src, f"{p}_fit", held=True)
    cte(f"{p}_q", f"SELECT entity, horizon, fold, quantile_cont(yk-pred, {_L}) AS rq, quantile_cont(yk, {_L}) AS qb FROM {p}_x WHERE learn GROUP BY 1,2,3", f"{p}_x", held=True)
    return cte(p, f"SELECT entity, month, pos, part, px, horizon, fold, yk, list_sort([{', '.join(f'pred+rq[{i + 1}]' for i in range(5))}]) AS qm, qb FROM {p}_x JOIN {p}_q USING (entity, horizon, fold) WHERE graded", f"{p}_x", f"{p}_q", held=True)


ridge_model("rq", "pjf", INPUTS)


def ridge_rows(spark, sf, features=INPUTS):
    """Walk-forward ridge: model and history quantiles of nine horizons, refitted every 12 rows on at least 48."""
    build = lambda: Q.ridge_quantiles(Q.refit_rows(outcomes(spark, sf)), features).select("entity", "month", "pos", "part", "px", "horizon", "fold", "yk", "qm", "qb")
    return materialise(spark, sf, f"ridge_{len(features)}", V.PANEL_TABLES, build)


@query("ridge_quantiles", sql("SELECT entity, month, CAST(horizon AS INTEGER) AS horizon, " + R("yk", *five("qm", "m"), *five("qb", "b")) + " FROM rq", "rq"))
def ridge_quantiles(spark, sf):
    return C.rounded(ridge_rows(spark, sf).select("entity", "month", "horizon", "yk", *fives("qm", "m"), *fives("qb", "b")))


def boosted_rows(spark, sf):
    """Walk-forward boosting of the pinball loss: 40 trees of depth 2 for each of five quantiles, nine horizons, all refits."""
    rows = Q.refit_rows(outcomes(spark, sf))
    return BO.fold_quantiles(rows, INPUTS, Q.LEVELS, ("entity", "horizon"), min_rows=Q.MIN_ROWS)


@query("boost_quantiles")
def boost_quantiles(spark, sf):
    return C.rounded(boosted_rows(spark, sf).select("entity", "horizon", "fold", "pos", *fives("q", "m")))


@query("average_quantiles")
def average_quantiles(spark, sf):
    """Mean of the two models, ridge with residual quantiles and boosting, where both have a fit."""
    b = boosted_rows(spark, sf).select("entity", "horizon", "fold", "pos", "q")
    j = ridge_rows(spark, sf).join(b, ["entity", "horizon", "fold", "pos"]).withColumn("qm", Q.average_members(F.col("qm"), F.col("q")))
    return C.rounded(j.select("entity", "month", "horizon", "yk", *fives("qm", "m")))


LAMS = (0.0, 0.25, 0.5, 0.75, 1.0)
cte("hl5", "SELECT h.*, lam, list_sort([" + ",".join(f"qb[{i}]+lam*(qm[{i}]-qb[{i}])" for i in range(1, 6)) + "]) AS q FROM rq h CROSS JOIN (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) v(lam)", "rq", held=True)


def shrunk(spark, sf, lams=LAMS):
    """The ridge's quantiles moved toward history, for a grid of trust in the model."""
    h = ridge_rows(spark, sf).withColumn("lam", F.explode(F.array(*[F.lit(x) for x in lams])))
    return h.withColumn("q", Q.shrink(F.col("qb"), F.col("qm"), F.col("lam")))


@query("shrink_quantiles", sql("SELECT entity, month, CAST(horizon AS INTEGER) AS horizon, lam, " + R(*five("q", "q")) + " FROM hl5", "hl5"))
def shrink_quantiles(spark, sf):
    return C.rounded(shrunk(spark, sf).select("entity", "month", "horizon", "lam", *fives("q", "q")))


PB = "(" + "+".join(f"greatest({t}e0*(yk-{{0}}[{i + 1}]),({t}e0-1e0)*(yk-{{0}}[{i + 1}]))" for i, t in enumerate(Q.LEVELS)) + ")/5e0"


@query("pinball", sql("SELECT entity, CAST(horizon AS INTEGER) AS horizon, lam, count(*) AS n, " + R(f"avg({PB.format('q')}) AS loss", digits=8) + " FROM hl5 WHERE yk IS NOT NULL GROUP BY 1,2,3", "hl5"))
def pinball(spark, sf):
    s = shrunk(spark, sf).filter(F.col("yk").isNotNull())
    g = s.groupBy("entity", "horizon", "lam").agg(F.count(F.lit(1)).alias("n"), F.avg(Q.pinball(F.col("yk"), F.col("q"))).alias("loss"))
    return C.rounded(g, 8)


cte("qs_r", """SELECT *, rank() OVER (PARTITION BY entity,horizon,lam ORDER BY mid)+(count(*) OVER (PARTITION BY entity,horizon,lam,mid)-1)/2e0 AS rx,
 rank() OVER (PARTITION BY entity,horizon,lam ORDER BY yk)+(count(*) OVER (PARTITION BY entity,horizon,lam,yk)-1)/2e0 AS ry, sign(round(q[3]-qb[3],12)) AS call, sign(yk-qb[3]) AS real
 FROM (SELECT *, round(q[3],12) AS mid FROM hl5 WHERE yk IS NOT NULL AND part IN ('val','test'))""", "hl5")


@query("quantile_score", sql("SELECT entity, CAST(horizon AS INTEGER) AS horizon, lam, n, " + R("ic", "hit", "1e0-pm/pb AS skill", "c80", "c50") + f""" FROM (SELECT entity, horizon, lam, count(*) AS n, CASE WHEN count(*)>=8 THEN {CORR} END AS ic,
 avg(CASE WHEN call<>0 THEN CASE WHEN call=real THEN 1e0 ELSE 0e0 END END) AS hit, avg({PB.format('q')}) AS pm, avg({PB.format('qb')}) AS pb,
 avg(CASE WHEN yk BETWEEN q[1] AND q[5] THEN 1e0 ELSE 0e0 END) AS c80, avg(CASE WHEN yk BETWEEN q[2] AND q[4] THEN 1e0 ELSE 0e0 END) AS c50 FROM qs_r GROUP BY 1,2,3 HAVING count(*)>=8)""", "qs_r"))
def quantile_score(spark, sf):
    s = shrunk(spark, sf).filter(F.col("part").isin("val", "test"))
    return C.rounded(Q.score(s, ["entity", "horizon", "lam"]))


# fit on every known row, read on the latest one; half way between history and model
cte("pjt", "SELECT *, n_all AS fold, yk IS NOT NULL AS learn, pos=n_all-1 AS graded FROM pjy WHERE yk IS NOT NULL OR pos=n_all-1", "pjy", held=True)
ridge_model("tq", "pjt", INPUTS)
cte("lastq", "SELECT *, list_sort([" + ",".join(f"qb[{i}]+0.5e0*(qm[{i}]-qb[{i}])" for i in range(1, 6)) + "]) AS q FROM tq", "tq", held=True)
MONTHS = max(Q.GRID)
cte("knots", "SELECT entity, horizon AS h, q FROM lastq UNION ALL SELECT DISTINCT entity, 0, [0e0,0e0,0e0,0e0,0e0] FROM lastq", "lastq")
cte("curve", f"SELECT entity, m, arg_max(q,h) FILTER (h<=m) AS lq, max(h) FILTER (h<=m) AS lo, arg_min(q,h) FILTER (h>=m) AS uq, min(h) FILTER (h>=m) AS up FROM knots, range({MONTHS + 1}) r(m) GROUP BY 1,2", "knots")
CURVE = "SELECT entity, CAST(m AS INTEGER) AS month_ahead, " + R(*[f"CASE WHEN up IS NULL OR up=lo THEN lq[{i}] ELSE lq[{i}]+(uq[{i}]-lq[{i}])*(m-lo)/(up-lo) END AS c{i - 1}" for i in range(1, 6)]) + " FROM curve"


def latest_quantiles(spark, sf):
    """Quantiles of the latest row from fits on every known row, half way between history and ridge."""
    t = Q.ridge_quantiles(Q.today_rows(outcomes(spark, sf)), INPUTS)
    return t.withColumn("q", Q.shrink(F.col("qb"), F.col("qm"), F.lit(0.5)))


@query("quantile_curve", sql(CURVE, "curve"))
def quantile_curve(spark, sf):
    c = Q.curve(latest_quantiles(spark, sf), ["entity"], MONTHS)
    return C.rounded(c.select("entity", "month_ahead", *fives("q", "c")))


_T = ("0.1e0", "0.25e0", "0.5e0", "0.75e0", "0.9e0")
CHANCE = "1e0-CASE WHEN q[1]>0 THEN 0.1e0 " + " ".join(f"WHEN q[{i + 2}]>0 THEN {_T[i]}+(0e0-q[{i + 1}])/(q[{i + 2}]-q[{i + 1}])*({_T[i + 1]}-{_T[i]})" for i in range(4)) + " ELSE 0.9e0 END"


@query("projection_table", sql("SELECT entity, CAST(horizon AS INTEGER) AS horizon, " + R("q[3] AS median", "q[1] AS lo80", "q[5] AS hi80", "q[2] AS lo50", "q[4] AS hi50", "px*exp(q[3]) AS level", f"{CHANCE} AS chance_up") + " FROM lastq", "lastq"))
def projection_table(spark, sf):
    s = latest_quantiles(spark, sf)
    at = lambda i: F.get("q", F.lit(i))
    return C.rounded(
        s.select(
            "entity", "horizon", at(2).alias("median"), at(0).alias("lo80"), at(4).alias("hi80"), at(1).alias("lo50"), at(3).alias("hi50"),
            (F.col("px") * F.exp(at(2))).alias("level"), Q.chance_positive(F.col("q")).alias("chance_up"),
        )
    )


@query("leaf_quantiles")
def leaf_quantiles(spark, sf, k: int = 3):
    """Quantile regression by leaves: one tree over all entities, then exact quantiles of the training outcomes per (entity, leaf),
    or of the leaf over all entities where the entity has no training row in it."""
    w = C.by_entity("entity")
    fw = P.feature_frame(spark, sf).withColumn("yk", Q.log_forward("px", k, w))
    x = VectorAssembler(inputCols=list(V.FEATURES), outputCol="v").transform(fw)
    train = x.filter((F.col("part") == "learn") & F.col("yk").isNotNull())
    tree = DecisionTreeRegressor(featuresCol="v", labelCol="yk", maxDepth=2, minInstancesPerNode=10, leafCol="leaf", seed=0).fit(train)
    fitted = tree.transform(train)
    found = lambda q, n: (F.percentile("yk", list(Q.LEVELS)).alias(q), F.count(F.lit(1)).alias(n))
    leaves = fitted.groupBy("entity", "leaf").agg(*found("q", "n"))
    pooled = fitted.groupBy("leaf").agg(*found("pooled_q", "pooled_n"))
    now = tree.transform(x.filter(F.col("part") == "test")).select("entity", "month", "leaf", "yk")
    j = now.join(leaves, ["entity", "leaf"], "left").join(pooled, "leaf", "left")
    j = j.withColumns({"n": F.coalesce("n", "pooled_n"), "q": F.coalesce("q", "pooled_q")})
    return C.rounded(j.select("entity", "month", "leaf", "n", "yk", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(5)]))


ridge_model("rq6", "pjf", V.FEATURES)
cte("arms", "SELECT *, 'indicators + price' AS arm FROM rq UNION ALL SELECT *, 'indicators' FROM rq6", "rq", "rq6")
cte("arm_r", """SELECT *, rank() OVER (PARTITION BY entity,horizon,arm ORDER BY mid)+(count(*) OVER (PARTITION BY entity,horizon,arm,mid)-1)/2e0 AS rx,
 rank() OVER (PARTITION BY entity,horizon,arm ORDER BY yk)+(count(*) OVER (PARTITION BY entity,horizon,arm,yk)-1)/2e0 AS ry, sign(round(q[3]-qb[3],12)) AS call, sign(yk-qb[3]) AS real
 FROM (SELECT *, qm AS q, round(qm[3],12) AS mid FROM arms WHERE yk IS NOT NULL AND part IN ('val','test'))""", "arms")


@query("arm_compare", sql("SELECT entity, CAST(horizon AS INTEGER) AS horizon, arm, n, " + R("ic", "hit", "1e0-pm/pb AS skill", "c80", "c50") + f""" FROM (SELECT entity, horizon, arm, count(*) AS n, CASE WHEN count(*)>=8 THEN {CORR} END AS ic,
 avg(CASE WHEN call<>0 THEN CASE WHEN call=real THEN 1e0 ELSE 0e0 END END) AS hit, avg({PB.format('q')}) AS pm, avg({PB.format('qb')}) AS pb,
 avg(CASE WHEN yk BETWEEN q[1] AND q[5] THEN 1e0 ELSE 0e0 END) AS c80, avg(CASE WHEN yk BETWEEN q[2] AND q[4] THEN 1e0 ELSE 0e0 END) AS c50 FROM arm_r GROUP BY 1,2,3 HAVING count(*)>=8)""", "arm_r"))
def arm_compare(spark, sf):
    """Scores with and without the price features, on the same rows."""
    a, b = (ridge_rows(spark, sf, f).withColumn("arm", F.lit(n)) for f, n in ((INPUTS, "indicators + price"), (V.FEATURES, "indicators")))
    rows = a.unionByName(b).withColumn("q", F.col("qm")).filter(F.col("part").isin("val", "test"))
    return C.rounded(Q.score(rows, ["entity", "horizon", "arm"]))


_DRIVE = " UNION ALL ".join(f"SELECT entity, '{f}' AS feature, w[{i + 1}]/s_{f} AS coef, w[{i + 1}]/s_{f}*({f}-m_{f})*100e0 AS contribution FROM pjt JOIN tq_fit USING (entity, horizon, fold) WHERE graded AND horizon=6" for i, f in enumerate(INPUTS))
cte("drive", f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(abs(contribution),9) DESC, feature) AS place FROM ({_DRIVE})", "pjt", "tq_fit")


@query("ridge_drivers", sql("SELECT entity, feature, " + R("coef", "contribution") + ", CAST(place AS INTEGER) AS place FROM drive WHERE place<=12", "drive"))
def ridge_drivers(spark, sf):
    """Contribution of every input to the latest six-month prediction, the twelve largest."""
    rows = Q.today_rows(outcomes(spark, sf).filter("horizon = 6"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature"))
    return C.rounded(Q.ridge_drivers(rows, INPUTS).withColumn("place", place).filter(F.col("place") <= 12))
