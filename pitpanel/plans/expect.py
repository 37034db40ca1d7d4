"""Expectation queries (group E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as AL
from ..operators import expect as X
from ..operators import rank as K
from ..operators import targets as T
from ..sources import views as V
from . import common as P
from .linear_sql import ridge_ctes, ridge_pred
from .rank import SIGN
from .registry import R, cte, erfc_sql, query, sql
from .rules import latest, percentiles
from .stats import hac_ctes, ic_cte, ranks_sql

cte("rates", "SELECT entity, month, pos, disc*100e0 AS y1, tax*100e0 AS y2, ret*10e0 AS y10, nopen*10e0 AS y3m, coalesce(CASE WHEN tax>0.04e0 THEN qty/100e0 END, nopen*10e0) AS ff, CASE WHEN count(CASE WHEN substr(entity,7,1)<>'1' THEN disc END) OVER (PARTITION BY entity)>0 THEN CASE WHEN substr(entity,7,1)<>'1' THEN disc*40e0 END ELSE tax*35e0 END AS infl, px FROM panel", "panel")
cte("ex", """SELECT *, ex_ff12-ff AS ex_ff_chg, ex_ff12-infl AS ex_real FROM (SELECT *, CASE WHEN ff+(1.25e0*y2-0.25e0*y1-y3m) IS NOT NULL THEN greatest(ff+(1.25e0*y2-0.25e0*y1-y3m),0e0) END AS ex_ff12,
 y10+(y10-y1)/10e0 AS ex_y10 FROM rates)""", "rates")


def expectations(spark, sf):
    """Curve-implied expectations from panel columns standing in for yields."""
    p = V.monthly_panel(spark, sf)
    survey = F.when(F.substring("entity", 7, 1) != "1", F.col("disc") * 40.0)  # entities without a survey use the break-even rate throughout
    p = p.select(
        "entity",
        "month",
        "pos",
        "px",
        (F.col("disc") * 100.0).alias("y1"),
        (F.col("tax") * 100.0).alias("y2"),
        (F.col("ret") * 10.0).alias("y10"),
        (F.col("nopen") * 10.0).alias("y3m"),
        F.coalesce(F.when(F.col("tax") > 0.04, F.col("qty") / 100.0), F.col("nopen") * 10.0).alias("ff"),
        AL.series_or(survey, F.col("tax") * 35.0, Window.partitionBy("entity")).alias("infl"),
    )
    y1, y2, y10, y3m, ff = (F.col(c) for c in ("y1", "y2", "y10", "y3m", "ff"))
    p = p.withColumn("ex_ff12", X.expected_policy_rate(ff, y1, y2, y3m)).withColumn("ex_y10", X.forward_ten_year(y10, y1))
    return p.withColumn("ex_ff_chg", F.col("ex_ff12") - ff).withColumn("ex_real", F.col("ex_ff12") - F.col("infl"))


EX = ("ex_ff12", "ex_ff_chg", "infl", "ex_real", "ex_y10")


@query("forward_rates", sql("SELECT entity, month, " + R(*EX) + " FROM ex", "ex"))
def forward_rates(spark, sf):
    return C.rounded(expectations(spark, sf).select("entity", "month", *EX))


Z = "(-0.5333e0-0.6330e0*(y10-y3m))"


@query("probit_prob", sql(f"SELECT entity, month, round(100e0*CASE WHEN {Z}>=0 THEN 1e0-0.5e0*{erfc_sql(f'abs({Z})/sqrt(2e0)')} ELSE 0.5e0*{erfc_sql(f'abs({Z})/sqrt(2e0)')} END,6)+0e0 AS recess FROM rates", "rates"))
def probit_prob(spark, sf):
    e = expectations(spark, sf)
    return C.rounded(e.select("entity", "month", X.recession_probability(F.col("y10"), F.col("y3m")).alias("recess")))


@query("threshold_labels", sql("""SELECT entity, CASE WHEN ex_ff_chg<=-0.25 THEN 'cuts' WHEN ex_ff_chg>=0.25 THEN 'hikes' ELSE 'roughly no change' END AS policy,
 CASE WHEN y10<2.0 THEN 'low' WHEN y10<4.0 THEN 'moderate' ELSE 'elevated' END AS risk, CASE WHEN usd>=0.01 THEN 'stronger' WHEN usd<=-0.01 THEN 'weaker' ELSE 'about flat' END AS dollar
 FROM (SELECT *, px/lag(px,3) OVER (PARTITION BY entity ORDER BY pos)-1e0 AS usd FROM ex) QUALIFY pos=max(pos) OVER (PARTITION BY entity)""", "ex"))
def threshold_labels(spark, sf):
    e = expectations(spark, sf).withColumn("usd", C.pct_change("px", 3, C.by_entity("entity")))
    now = latest(e, ["entity"], ["ex_ff_chg", "y10", "usd"])
    c, r, u = F.col("ex_ff_chg"), F.col("y10"), F.col("usd")
    return now.select(
        "entity",
        F.when(c <= -0.25, "cuts").when(c >= 0.25, "hikes").otherwise("roughly no change").alias("policy"),
        F.when(r < 2.0, "low").when(r < 4.0, "moderate").otherwise("elevated").alias("risk"),
        F.when(u >= 0.01, "stronger").when(u <= -0.01, "weaker").otherwise("about flat").alias("dollar"),
    )


cte("gf", " UNION ALL ".join(f"SELECT entity, month, '{k}' AS k, {f} AS forecast, {a} AS anchor, lead({r},6) OVER (PARTITION BY entity ORDER BY pos) AS realised FROM ex"
    for k, f, a, r in (("ff", "ex_ff12", "ff", "ff"), ("y10", "ex_y10", "y10", "y10"), ("real", "ex_real", "ff-infl", "ff-infl"))), "ex")
cte("gfr", """SELECT *, rank() OVER (PARTITION BY entity, k ORDER BY round(df,9)) + (count(*) OVER (PARTITION BY entity, k, round(df,9))-1)/2e0 AS rx,
 rank() OVER (PARTITION BY entity, k ORDER BY round(dr,9)) + (count(*) OVER (PARTITION BY entity, k, round(dr,9))-1)/2e0 AS ry
 FROM (SELECT *, forecast-anchor AS df, realised-anchor AS dr FROM gf WHERE forecast IS NOT NULL AND anchor IS NOT NULL AND realised IS NOT NULL)""", "gf")


@query("grade_forecasts", sql("""SELECT entity, k, n, """ + R("mae_m", "mae_n", "1e0-mae_m/mae_n AS skill", "ic") + """ FROM (SELECT entity, k, count(*) AS n, avg(abs(forecast-realised)) AS mae_m, avg(abs(anchor-realised)) AS mae_n,
 (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0) AS ic FROM gfr GROUP BY 1,2 HAVING count(*)>=24)""", "gfr"))
def grade_forecasts(spark, sf, h: int = 6):
    e = expectations(spark, sf)
    w = C.by_entity("entity")
    real = F.col("ff") - F.col("infl")
    spec = (("ff", F.col("ex_ff12"), F.col("ff")), ("y10", F.col("ex_y10"), F.col("y10")), ("real", F.col("ex_real"), real))
    items = [F.struct(F.lit(k).alias("k"), f.alias("forecast"), a.alias("anchor"), F.lead(a, h).over(w).alias("realised")) for k, f, a in spec]
    long = e.withColumn("o", F.array(*items)).select("entity", "month", F.explode("o").alias("o")).select("entity", "month", "o.*")
    return C.rounded(X.grade_forecasts(long, ["entity", "k"]))


cte("tally", """SELECT entity, CASE WHEN sgn=0 THEN 'mixed' WHEN pit IS NULL THEN NULL WHEN (pit>=CAST(2 AS DOUBLE)/3 AND sgn>0) OR (pit<=CAST(1 AS DOUBLE)/3 AND sgn<0) THEN 'supportive'
 WHEN (pit>=CAST(2 AS DOUBLE)/3 AND sgn<0) OR (pit<=CAST(1 AS DOUBLE)/3 AND sgn>0) THEN 'against' ELSE 'middle' END AS c
 FROM (SELECT entity, feature, arg_max(pit,pos) AS pit FROM pctl WHERE pit IS NOT NULL GROUP BY 1,2) JOIN meta USING (feature)""", "pctl", "meta")


@query("textbook_tally", sql("SELECT entity, " + ", ".join(f"count(*) FILTER (c='{c}') AS {c}" for c in ("supportive", "against", "middle", "mixed")) + " FROM tally GROUP BY 1", "tally"))
def textbook_tally(spark, sf):
    p = percentiles(spark, sf).filter(F.col("pit").isNotNull())
    now = p.groupBy("entity", "feature").agg(F.max_by("pit", "pos").alias("pit"))
    sign = F.create_map(*[F.lit(x) for kv in SIGN.items() for x in kv])[F.col("feature")]
    c = now.withColumn("c", X.tally_class(sign, F.col("pit"))).groupBy("entity")
    return c.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(k) for k in ("supportive", "against", "middle", "mixed")])


cte("xt0", "SELECT entity, month, pos, ret, tax, px, least(greatest(qty/lag(qty,1) OVER (PARTITION BY entity ORDER BY pos)-1e0,-0.4e0),0.4e0) AS fl, lag(qty,1) OVER (PARTITION BY entity ORDER BY pos) AS q1 FROM panel", "panel")
cte("xt1", "SELECT * REPLACE (CASE WHEN q1 IS NOT NULL THEN fl END AS fl) FROM xt0", "xt0")
_XT = {"level": ("ret", "lead(ret,6) OVER w"), "change": ("tax", "lead(tax,6) OVER w-tax"), "percent": ("px/lag(px,6) OVER w-1e0", "lead(px,6) OVER w/px-1e0"), "flow": ("fl", "lead(fl,6) OVER w")}
cte("xt", " UNION ALL ".join(f"SELECT entity, month, '{k}' AS target, {o} AS own, {y} AS y FROM xt1 WINDOW w AS (PARTITION BY entity ORDER BY pos)" for k, (o, y) in _XT.items()), "xt1")


def target_rows(df, h: int):
    """One row per (row, target); the target is a key, not a loop."""
    t = X.targets(C.by_entity("entity"), h, "ret", "tax", "px", "qty")
    items = [F.struct(F.lit(k).alias("target"), own.alias("own"), y.alias("ty")) for k, (own, y) in t.items()]
    return df.withColumn("_i", F.array(*items)).withColumn("_t", F.explode("_i")).select("*", "_t.*").drop("_i", "_t")


@query("expectation_targets", sql("SELECT entity, month, target, " + R("own", "y", digits=8) + " FROM xt", "xt"))
def expectation_targets(spark, sf):
    t = target_rows(V.monthly_panel(spark, sf), 6)
    return C.rounded(t.select("entity", "month", "target", "own", F.col("ty").alias("y")), 8)


# inputs that some entities lack: one is empty, one starts too late for all, one for some
LATE = "2001-06-30"
INPUTS = (*V.FEATURES, "late", "gone", "part_late")
cte("xin", f"""SELECT f.entity, f.month, f.pos, {", ".join("f." + c for c in V.FEATURES)}, CASE WHEN f.month>=DATE '{LATE}' THEN f.qty END AS late, CAST(NULL AS DOUBLE) AS gone,
 CASE WHEN f.month>=DATE '{LATE}' OR substr(f.entity,7,1) IN ('3','4','5') THEN f.nopen END AS part_late FROM feat_all f""", "feat_all")
_XL = " UNION ALL ".join(f"SELECT entity, month, '{c}' AS input, {c} AS x FROM xin" for c in INPUTS)
cte("xch", f"SELECT entity, input, first, coalesce(first<=last_day(CAST(start + INTERVAL {X.LATE_MONTHS} MONTH AS DATE)),false) AS used FROM (SELECT entity, input, min(month) AS start, min(month) FILTER (x IS NOT NULL) AS first FROM ({_XL}) GROUP BY 1,2)", "xin", held=True)


def input_rows(spark, sf):
    late = F.col("month") >= F.lit(LATE).cast("date")
    partly = late | F.substring("entity", 7, 1).isin("3", "4", "5")
    return P.features_all(spark, sf).withColumns({"late": F.when(late, F.col("qty")), "gone": F.lit(None).cast("double"), "part_late": F.when(partly, F.col("nopen"))})


@query("input_choice", sql(f"SELECT entity, input, first, used, count(*) FILTER (used) OVER (PARTITION BY entity)>={X.LEAST_INPUTS} AS enough FROM xch", "xch"))
def input_choice(spark, sf):
    """Which inputs an entity's forecasts use: empty and late ones are dropped, three must remain."""
    used = X.input_table(input_rows(spark, sf), INPUTS)
    n = F.count(F.when(F.col("used"), 1)).over(Window.partitionBy("entity"))
    return used.withColumn("enough", n >= X.LEAST_INPUTS)


_XU = ", ".join(f"CASE WHEN list_contains(u,'{c}') THEN {c} ELSE 0e0 END AS {c}" for c in INPUTS)
_XW = " AND ".join(f"{c} IS NOT NULL" for c in (*INPUTS, "own"))
cte("xt12", " UNION ALL ".join(f"SELECT entity, month, '{k}' AS target, {o.replace(',6)', ',12)')} AS own, {y.replace(',6)', ',12)')} AS y FROM xt1 WINDOW w AS (PARTITION BY entity ORDER BY pos)" for k, (o, y) in _XT.items()), "xt1")
cte("xrow", f"SELECT entity, target, month, pos, {_XU}, own, y FROM xin JOIN (SELECT entity, list(input) AS u FROM xch WHERE used GROUP BY 1 HAVING count(*)>={X.LEAST_INPUTS}) USING (entity) JOIN xt12 USING (entity, month)", "xin", "xch", "xt12", held=True)
cte("xfold", f"""SELECT *, pos<fold AS learn, pos>=fold AS graded FROM (SELECT *, CAST(unnest(generate_series(f0, n0-1, {X.STEP})) AS INTEGER) AS fold FROM (
 SELECT *, min(pos) FILTER ({_XW}) OVER (PARTITION BY entity, target)+{X.MIN_ROWS + X.H} AS f0, max(pos) OVER (PARTITION BY entity, target)+1 AS n0 FROM xrow) WHERE {_XW} AND f0<n0)
 WHERE (pos<=fold-{X.H} AND y IS NOT NULL) OR (pos>=fold AND pos<fold+{X.STEP})""", "xrow", held=True)
ridge_ctes("xr", "xfold", "entity, target, fold", (*INPUTS, "own"), "y", X.ALPHA, X.MIN_ROWS)


@query("wf_ridge", sql("SELECT entity, target, month, n_train, " + R(f"{ridge_pred((*INPUTS, 'own'))} AS pred", "y") + " FROM xfold JOIN xr_fit USING (entity, target, fold) WHERE graded", "xfold", "xr_fit"))
def wf_ridge(spark, sf):
    """Forecast of every target 12 months ahead, refitted every three rows on at least 60, each entity on its own inputs."""
    t = target_rows(X.chosen_inputs(input_rows(spark, sf), INPUTS), X.H)
    out = X.expanding_forecast(t, (*INPUTS, "own"), "ty", ["entity", "target"])
    return C.rounded(out.select("entity", "target", "month", "n_train", "pred", F.col("ty").alias("y")))


# --------------------------------------------------------------------------- links of expectations and outcomes
LINKS = {"ex_ff12": 1, "ex_ff_chg": -1, "infl": 0, "ex_real": -1, "ex_y10": 1, "px_m12": 1, "qty_c24": 0}
cte("lk", "SELECT f.entity, f.pos, f.part, f.y, " + ", ".join(f"round(x.{c},9) AS {c}" for c in EX) + ", round(p12,9) AS px_m12, round(q24,9) AS qty_c24 FROM fw f JOIN ex x USING (entity, month) JOIN (SELECT entity, month, px/lag(px,12) OVER w-1e0 AS p12, qty/lag(qty,24) OVER w-1e0 AS q24 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY pos)) USING (entity, month)", "fw", "ex", "panel", held=True)
cte("lkl", " UNION ALL ".join(f"SELECT entity, pos, part, y, '{c}' AS feature, {s} AS sgn, {c} AS x FROM lk WHERE {c} IS NOT NULL AND y IS NOT NULL" for c, s in LINKS.items()), "lk", held=True)
ic_cte("lkil", "lkl", "entity, feature", where="part='learn'")
ic_cte("lkiu", "lkl", "entity, feature", where="part IN ('val','test')")
cte("lkr", ranks_sql("lkl", "entity, feature", "x", "y", "part='learn'"), "lkl")
hac_ctes("lkh", "lkr", "entity, feature", "ry", "rx", 3)


@query("link_table", sql("""SELECT entity, feature, n AS n_learn, """ + R("ic_l", "ic_u", "t") + """, CASE WHEN ic_l IS NULL OR ic_u IS NULL THEN '-' WHEN sign(ic_l)<>sign(ic_u) THEN 'flips on unseen data' WHEN abs(t)>=2 THEN 'consistent and significant' ELSE 'consistent but weak' END AS status,
 CASE WHEN sgn<>0 AND ic_l IS NOT NULL THEN sign(ic_l)=sgn END AS textbook FROM (SELECT entity, feature, l.n, l.ic AS ic_l, u.ic AS ic_u, CASE WHEN l.n>8 THEN t END AS t FROM lkil l LEFT JOIN lkiu u USING (entity, feature) JOIN lkh_t USING (entity, feature))
 JOIN (SELECT DISTINCT feature, sgn FROM lkl) USING (feature)""", "lkil", "lkiu", "lkh_t", "lkl"))
def link_table(spark, sf):
    """Expectation indicators against the outcome, each on the rows that it has: a short one shortens no other."""
    w = C.by_entity("entity")
    e = expectations(spark, sf).select("entity", "month", *[F.round(c, 9).alias(c) for c in EX])
    late = V.monthly_panel(spark, sf).select("entity", "month", C.stable(C.pct_change("px", 12, w), 9).alias("px_m12"), C.stable(C.pct_change("qty", 24, w), 9).alias("qty_c24"))
    f = P.feature_frame(spark, sf).select("entity", "month", "pos", "part", "y").join(e, ["entity", "month"]).join(late, ["entity", "month"])
    return C.rounded(K.links(T.long_form(f, LINKS, ("entity", "pos", "part", "y")), V.H, LINKS))
