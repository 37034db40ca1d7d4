"""Targets, splits, states, rules, verdicts (groups F and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import order as O
from ..operators import states as S
from ..operators import targets as T
from ..sources import views as V
from . import common as P
from .registry import R, cte, erfc_sql, query, sql

# --------------------------------------------------------------------------- SQL of the rule chain


def state_ctes(p: str, src: str, keys: str) -> str:
    cte(f"{p}_cut", f"""
 SELECT {keys}, feature, quantile_cont(x, CAST(1 AS DOUBLE)/3) FILTER (learn) AS lo, quantile_cont(x, CAST(2 AS DOUBLE)/3) FILTER (learn) AS hi
 FROM {src} GROUP BY {keys}, feature""", src)
    cte(f"{p}_st", f"""
 SELECT s.*, lo, hi, CASE WHEN x IS NULL OR lo IS NULL THEN NULL WHEN round(x,12)<=round(lo,12) THEN 'Low' WHEN round(x,12)<=round(hi,12) THEN 'Mid' ELSE 'High' END AS state
 FROM {src} s JOIN {p}_cut c USING ({keys}, feature)""", src, f"{p}_cut")
    return f"{p}_st"


def stat_ctes(p: str, src: str, keys: str, h: int = 3) -> str:
    """Bucket statistics of learn rows in `src` (which has a boolean `learn`)."""
    g = f"{keys}, feature, state"
    lags = ", ".join(f"sum(u*u{k}) AS s{k}" for k in range(1, h + 1))
    lagc = ", ".join(f"lag(u,{k}) OVER w AS u{k}" for k in range(1, h + 1))
    var = " + ".join(["s0"] + [f"2e0*(1e0-{k}/{h + 1}e0)*coalesce(s{k},0)" for k in range(1, h + 1)])
    cte(f"{p}_bx", f"""
 SELECT {keys}, feature, v.s AS state, pos, y, CASE WHEN l.state=v.s THEN 1e0 ELSE 0e0 END AS d,
   row_number() OVER (PARTITION BY {keys}, feature, v.s ORDER BY pos) > count(*) OVER (PARTITION BY {keys}, feature, v.s)//2 AS second
 FROM {src} l CROSS JOIN (VALUES ('Low'),('Mid'),('High')) v(s) WHERE l.learn""", src)
    cte(f"{p}_bm", f"""
 SELECT {g}, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(d) AS sd, sum(d*y) AS sdy, CAST(count(*) AS DOUBLE)*sum(d*d)-sum(d)*sum(d) AS dd
 FROM {p}_bx GROUP BY {g}""", f"{p}_bx")
    cte(f"{p}_bb", f"""
 SELECT *, CASE WHEN dd>0 THEN (n*sdy-sd*sy)/dd ELSE (sd/n)*(sy/n)/(1e0+(sd/n)*(sd/n)) END AS b FROM {p}_bm""", f"{p}_bm")
    cte(f"{p}_bu", f"""
 SELECT {', '.join('x.' + c for c in g.split(', '))}, pos, b,
   (y-(sy-b*sd)/n-b*d)*(CASE WHEN dd>0 THEN (n*d-sd)/dd ELSE (sd/n)/(n*(1e0+(sd/n)*(sd/n))) END) AS u
 FROM {p}_bx x JOIN {p}_bb m USING ({g})""", f"{p}_bx", f"{p}_bb")
    cte(f"{p}_bt", f"""
 SELECT {g}, CASE WHEN var>0 THEN b/sqrt(var) ELSE 0e0 END AS t FROM (
  SELECT {g}, b, {var} AS var FROM (SELECT {g}, any_value(b) AS b, sum(u*u) AS s0, {lags} FROM
   (SELECT *, {lagc} FROM {p}_bu WINDOW w AS (PARTITION BY {g} ORDER BY pos)) GROUP BY {g}))""", f"{p}_bu")
    cte(f"{p}_ba", f"""
 SELECT {g}, count(*) FILTER (d=1) AS n, avg(y) FILTER (d=1) AS avg, quantile_cont(y,0.5) FILTER (d=1) AS median,
  avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) FILTER (d=1) AS win, avg(y) FILTER (d=1) - avg(y) AS edge,
  CASE WHEN count(*) FILTER (d=1 AND NOT second)>=4 THEN avg(y) FILTER (d=1 AND NOT second) - avg(y) FILTER (NOT second) END AS e1,
  CASE WHEN count(*) FILTER (d=1 AND second)>=4 THEN avg(y) FILTER (d=1 AND second) - avg(y) FILTER (second) END AS e2
 FROM {p}_bx GROUP BY {g}""", f"{p}_bx")
    cte(f"{p}_bp", f"""
 SELECT a.*, t, {erfc_sql('abs(t)/sqrt(2e0)')} AS p,
  coalesce(sign(round(e1,12))=sign(round(e2,12)) AND sign(round(e2,12))=sign(round(edge,12)), false) AS consistent
 FROM {p}_ba a JOIN {p}_bt USING ({g}) WHERE n>=8""", f"{p}_ba", f"{p}_bt")
    cte(f"{p}_bq", f"""
 SELECT *, least(min(r) OVER (PARTITION BY {keys} ORDER BY rn DESC), 1e0) AS q FROM (
  SELECT *, p*count(*) OVER (PARTITION BY {keys})/row_number() OVER (PARTITION BY {keys} ORDER BY p, feature, state) AS r,
   row_number() OVER (PARTITION BY {keys} ORDER BY p, feature, state) AS rn FROM {p}_bp)""", f"{p}_bp")
    return f"{p}_bq"


def rule_ctes(p: str, keys: str, cond: str = "abs(t)>=1", weight: str = "1e0") -> str:
    cte(f"{p}_rl", f"""
 SELECT *, sign(round(edge,12))*{weight} AS weight FROM {p}_bq WHERE {cond} AND round(edge,12)<>0""", f"{p}_bq")
    return f"{p}_rl"


def verdict_ctes(p: str, keys: str) -> str:
    on = f"{keys}, feature, state"
    cte(f"{p}_sc", f"""
 SELECT {', '.join('s.' + k for k in keys.split(', '))}, s.pos, any_value(s.month) AS month, any_value(s.y) AS y, any_value(s.part) AS part,
   any_value(s.learn) AS learn, coalesce(sum(weight),0e0) AS score
 FROM {p}_st s LEFT JOIN {p}_rl USING ({on}) GROUP BY {', '.join('s.' + k for k in keys.split(', '))}, s.pos""", f"{p}_st", f"{p}_rl")
    cte(f"{p}_vq", f"SELECT {keys}, quantile_cont(score,0.25) FILTER (learn) AS q25, quantile_cont(score,0.75) FILTER (learn) AS q75 FROM {p}_sc GROUP BY {keys}", f"{p}_sc")
    cte(f"{p}_vd", f"""
 SELECT s.*, CASE WHEN score<=q25 AND score<0 THEN 'Unfavorable' WHEN score>=q75 AND score>0 THEN 'Favorable' ELSE 'Neutral' END AS verdict
 FROM {p}_sc s JOIN {p}_vq USING ({keys})""", f"{p}_sc", f"{p}_vq")
    return f"{p}_vd"


def chain_ctes(p: str, src: str, keys: str, cond: str = "abs(t)>=1", weight: str = "1e0") -> str:
    st = state_ctes(p, src, keys)
    stat_ctes(p, st, keys)
    rule_ctes(p, keys, cond, weight)
    return verdict_ctes(p, keys)


cte("s1", "SELECT *, part='learn' AS learn FROM fl", "fl")
chain_ctes("a", "s1", "entity")
cte("fold", """
 SELECT entity, CAST(s0 AS INTEGER) AS fold FROM (SELECT entity, unnest(generate_series(c1, n_all-1, 6)) AS s0
 FROM (SELECT DISTINCT entity, c1, n_all FROM fw))""", "fw")
cte("s2", """
 SELECT f.*, fold, pos < fold-3 AND y IS NOT NULL AS learn FROM fl f JOIN fold USING (entity)
 WHERE pos < fold-3 OR (pos >= fold AND pos < fold+6)""", "fl", "fold")
chain_ctes("w", "s2", "entity, fold")


# --------------------------------------------------------------------------- F: targets and splits
HORIZONS = (1, 2, 3, 6, 9, 12, 18, 24)


@query("fwd_return", sql("SELECT entity, month, CAST(h AS INTEGER) AS horizon, " + R("y", "y2") + " FROM (" + " UNION ALL ".join(
    f"SELECT entity, month, {h} AS h, lead(px,{h}) OVER (PARTITION BY entity ORDER BY pos)/px-1e0 AS y, lead(px2,{h}) OVER (PARTITION BY entity ORDER BY pos)/px2-1e0 AS y2 FROM panel"
    for h in HORIZONS) + ")", "panel"))
def fwd_return(spark, sf):
    w = C.by_entity("entity")
    each = [
        F.struct(F.lit(h).alias("horizon"), C.forward_return("px", h, w).alias("y"), C.forward_return("px2", h, w).alias("y2"))
        for h in HORIZONS
    ]
    p = V.monthly_panel(spark, sf).withColumn("o", F.array(*each))
    return C.rounded(p.select("entity", "month", F.explode("o").alias("o")).select("entity", "month", "o.*"))


cte("r1", """SELECT *, px/lag(px,1) OVER w - 1e0 AS px_r1, lead(px,3) OVER w/px-1e0 AS y, lead(px2,3) OVER w/px2-1e0 AS y2, disc*100e0 AS irx
 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY pos)""", "panel")
cte("r2", """SELECT *, CASE WHEN count(px_r1) OVER w >= 12 THEN round(stddev_samp(px_r1) OVER w*sqrt(12e0),12) END AS vol FROM r1
 WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "r1")


def market(spark, sf):
    """Panel with one-row returns, both forward returns and a cash quote."""
    w = C.by_entity("entity")
    return (
        V.monthly_panel(spark, sf)
        .withColumn("px_r1", C.pct_change("px", 1, w))
        .withColumn("y", C.forward_return("px", 3, w))
        .withColumn("y2", C.forward_return("px2", 3, w))
        .withColumn("irx", F.col("disc") * 100.0)
        .withColumn("vol", T.trailing_vol("px", w))
    )


@query("fwd_vol_scaled", sql("""SELECT entity, month, """ + R("vol", "y_vol") + """ FROM (SELECT *,
 y*coalesce(CASE WHEN vol IS NOT NULL AND vol<>0 THEN least(greatest(0.5e0/vol,0.25e0),2e0) END,1e0) AS y_vol FROM r2)""", "r2"))
def fwd_vol_scaled(spark, sf):
    m = market(spark, sf)
    return C.rounded(m.select("entity", "month", "vol", T.vol_scaled(F.col("y"), F.col("vol"), 0.5).alias("y_vol")))


@query("fwd_relative", sql("""SELECT entity, month, """ + R("y-y2 AS y_rel", "y-coalesce(pow(1e0+irx/100e0,0.25e0)-1e0,0e0) AS y_cash") + " FROM r1", "r1"))
def fwd_relative(spark, sf):
    m = market(spark, sf)
    return C.rounded(
        m.select("entity", "month", (F.col("y") - F.col("y2")).alias("y_rel"), (F.col("y") - T.cash_rate("irx", 3)).alias("y_cash"))
    )


@query("cash_rate", sql("SELECT entity, month, " + R("coalesce(pow(1e0+irx/100e0,1e0/12e0)-1e0,0e0) AS rf", digits=9) + " FROM r1", "r1"))
def cash(spark, sf):
    m = V.monthly_panel(spark, sf).withColumn("irx", F.col("disc") * 100.0)
    return C.rounded(m.select("entity", "month", T.cash_rate("irx").alias("rf")), 9)


cte("ddx", """
 SELECT entity, pos, h, min(x/top-1e0) AS dd, count(*) AS n FROM (
  SELECT a.entity, a.pos, h, b.px AS x, max(b.px) OVER (PARTITION BY a.entity, a.pos, h ORDER BY b.pos) AS top
  FROM panel a CROSS JOIN (VALUES (3),(6)) v(h) JOIN panel b ON a.entity=b.entity AND b.pos BETWEEN a.pos AND a.pos+h)
 GROUP BY ALL""", "panel")


@query("fwd_drawdown", sql("""SELECT p.entity, p.month, CAST(h AS INTEGER) AS horizon, CASE WHEN n=h+1 THEN round(dd,6)+0e0 END AS dd
 FROM panel p JOIN ddx USING (entity,pos)""", "panel", "ddx"))
def fwd_drawdown(spark, sf):
    w = C.by_entity("entity")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), T.forward_drawdown("px", h, w).alias("dd")) for h in (3, 6)])
    p = V.monthly_panel(spark, sf).withColumn("o", each)
    return C.rounded(p.select("entity", "month", F.explode("o").alias("o")).select("entity", "month", "o.*"))


@query("fwd_drawdown_flag", sql("""SELECT p.entity, p.month, CASE WHEN n=7 THEN round(dd+0.30e0,6)+0e0 END AS y_dd,
 CASE WHEN n=7 THEN CASE WHEN dd>-0.30e0 THEN 1e0 ELSE 0e0 END END AS y_flag FROM panel p JOIN ddx USING (entity,pos) WHERE h=6""", "panel", "ddx"))
def fwd_drawdown_flag(spark, sf, floor: float = 0.30):
    dd = T.forward_drawdown("px", 6, C.by_entity("entity"))
    p = V.monthly_panel(spark, sf).withColumn("dd", dd)
    return C.rounded(
        p.select("entity", "month", (F.col("dd") + floor).alias("y_dd"), (F.col("dd") > -floor).cast("double").alias("y_flag"))
    )


@query("split3", sql("SELECT entity, month, pos, part, c1, c2 FROM fw", "fw"))
def split3(spark, sf):
    return P.feature_frame(spark, sf).select("entity", "month", "pos", "part", "c1", "c2")


@query("folds", sql("""SELECT entity, fold, CAST(least(fold+6, n_all) AS INTEGER) AS te_end, CAST(fold-3 AS INTEGER) AS learn_end,
 count(*) FILTER (pos<fold-3 AND y IS NOT NULL) AS n_learn FROM fw JOIN fold USING (entity) GROUP BY entity, fold, n_all""", "fw", "fold"))
def folds(spark, sf):
    rows = T.fold_rows(P.feature_frame(spark, sf), V.H, P.STEP)
    return rows.groupBy("entity", "fold", "n_all").agg(F.count(F.when(F.col("learn"), 1)).alias("n_learn")).select(
        "entity",
        "fold",
        F.least(F.col("fold") + P.STEP, F.col("n_all")).alias("te_end"),
        (F.col("fold") - V.H).alias("learn_end"),
        "n_learn",
    )


@query("history_guard", sql("""SELECT entity, n_rows, n_learn, n_val, n_test, CASE WHEN n_rows<60 THEN 'rows' WHEN n_learn<36 THEN 'learn' WHEN n_val<8 THEN 'validation'
 WHEN n_test<12 THEN 'test' ELSE 'ok' END AS reason FROM (SELECT entity, count(*) AS n_rows, count(*) FILTER (part='learn') AS n_learn,
 count(*) FILTER (part='val') AS n_val, count(*) FILTER (part='test') AS n_test FROM fw GROUP BY entity)""", "fw"))
def history_guard(spark, sf):
    n = lambda p: F.count(F.when(F.col("part") == p, 1))
    g = P.feature_frame(spark, sf).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"), n("learn").alias("n_learn"), n("val").alias("n_val"), n("test").alias("n_test")
    )
    return g.withColumn(
        "reason",
        F.when(F.col("n_rows") < 60, "rows").when(F.col("n_learn") < 36, "learn").when(F.col("n_val") < 8, "validation")
        .when(F.col("n_test") < 12, "test").otherwise("ok"),
    )


# --------------------------------------------------------------------------- G: states and rules
@query("tercile_state", sql("SELECT entity, month, feature, " + R("x", "lo", "hi", digits=8) + ", state FROM a_st", "a_st"))
def tercile_state(spark, sf):
    fl = P.feature_long(spark, sf)
    st = S.tercile_states(fl, ["entity", "feature"], F.col("part") == "learn")
    return C.rounded(st.select("entity", "month", "feature", "x", "lo", "hi", "state"), 8)


cte("pctl", """
 SELECT a.entity, a.pos, a.month, a.feature, a.x, a.y, a.part, CASE WHEN count(b.x)>=35 THEN CAST(count(*) FILTER (b.x<a.x) AS DOUBLE)/count(b.x) END AS pit
 FROM fl a LEFT JOIN fl b ON a.entity=b.entity AND a.feature=b.feature AND b.pos<a.pos GROUP BY ALL""", "fl")


def percentiles(spark, sf):
    fl = P.feature_long(spark, sf)
    return O.expanding_percentile(fl, "x", ["entity", "feature"], "pit", bits=O.bits_of(P.feature_frame(spark, sf)))


@query("expanding_pctl", sql("SELECT entity, month, feature, " + R("pit") + " FROM pctl", "pctl"))
def expanding_pctl(spark, sf):
    return C.rounded(percentiles(spark, sf).select("entity", "month", "feature", "pit"))


cte("rpx", "SELECT entity, month, pos, px/px2 AS x FROM panel", "panel")


@query("real_price_pctl", sql("""SELECT a.entity, a.month, CASE WHEN count(b.x)>=35 THEN round(CAST(count(*) FILTER (b.x<a.x) AS DOUBLE)/count(b.x),6)+0e0 END AS pit
 FROM rpx a LEFT JOIN rpx b ON a.entity=b.entity AND b.pos<a.pos GROUP BY a.entity, a.month, a.x""", "rpx"))
def real_price_pctl(spark, sf):
    """Expanding percentile of a price deflated by an index."""
    p = V.monthly_panel(spark, sf).withColumn("x", C.ratio("px", "px2"))
    return C.rounded(O.expanding_percentile(p, "x", ["entity"], "pit").select("entity", "month", "pit"))


@query("pit_state", sql("""SELECT entity, feature, CASE WHEN pit IS NULL THEN NULL WHEN pit<=CAST(1 AS DOUBLE)/3 THEN 'Low' WHEN pit<=CAST(2 AS DOUBLE)/3 THEN 'Mid' ELSE 'High' END AS state,
 count(*) AS n FROM pctl GROUP BY ALL""", "pctl"))
def pit_state(spark, sf):
    p = percentiles(spark, sf).withColumn("state", S.percentile_state("pit"))
    return p.groupBy("entity", "feature", "state").agg(F.count(F.lit(1)).alias("n"))


BS_OUT = ("avg", "median", "win", "edge", "t", "p", "q")


@query("bucket_stats", sql("SELECT entity, feature, state, n, consistent, " + R(*BS_OUT) + " FROM a_bq", "a_bq"))
def bucket_stats(spark, sf):
    _, bs, _, _ = P.learned(spark, sf)
    return C.rounded(bs.select("entity", "feature", "state", "n", "consistent", *BS_OUT))


cte("sel", """SELECT 't' AS chosen_by, false AS need, 1e0 AS w, * FROM a_bq WHERE abs(t)>=1
 UNION ALL SELECT 'q', true, least(greatest(abs(t)-1,0),3), * FROM a_bq WHERE q<=0.8 AND consistent""", "a_bq")


@query("select_rules", sql("SELECT chosen_by, entity, feature, state, round(sign(round(edge,12))*w,6)+0e0 AS weight FROM sel WHERE round(edge,12)<>0", "sel"))
def select_rules(spark, sf):
    _, bs, rules, _ = P.learned(spark, sf)
    alt = S.select_rules(bs, S.RuleConfig(by="q", threshold=0.8, consistent=True, weighting="t"))
    cols = ["chosen_by", "entity", "feature", "state", "weight"]
    a, b = rules.withColumn("chosen_by", F.lit("t")).select(cols), alt.withColumn("chosen_by", F.lit("q")).select(cols)
    return C.rounded(a.unionByName(b))


@query("rule_score", sql("SELECT entity, month, part, " + R("score") + " FROM a_vd", "a_vd"))
def rule_score(spark, sf):
    return C.rounded(P.learned(spark, sf)[3].select("entity", "month", "part", "score"))


@query("verdict", sql("SELECT entity, month, part, verdict FROM a_vd", "a_vd"))
def verdict(spark, sf):
    return P.learned(spark, sf)[3].select("entity", "month", "part", "verdict")


cte("spread", """SELECT entity, part, count(*) FILTER (verdict='Favorable' AND y IS NOT NULL) AS n_fav, count(*) FILTER (verdict='Unfavorable' AND y IS NOT NULL) AS n_unf,
 (avg(y) FILTER (verdict='Favorable') - avg(y) FILTER (verdict='Unfavorable'))*100 AS d FROM a_vd GROUP BY entity, part""", "a_vd")


@query("run_rules", sql("SELECT entity, part, verdict, count(*) AS months, " + R("avg(y) AS avg_y") + " FROM a_vd GROUP BY ALL", "a_vd"))
def run_rules(spark, sf):
    v = P.learned(spark, sf)[3]
    return C.rounded(v.groupBy("entity", "part", "verdict").agg(F.count(F.lit(1)).alias("months"), F.avg("y").alias("avg_y")))


@query("fav_unf_spread", sql("SELECT entity, part, n_fav, n_unf, CASE WHEN n_fav>=3 AND n_unf>=3 THEN round(d,6)+0e0 END AS spread FROM spread", "spread"))
def fav_unf_spread(spark, sf):
    return C.rounded(S.favorable_spread(P.learned(spark, sf)[3], ["entity", "part"]))


@query("wf_rules", sql("""SELECT entity, fold, month, verdict, round(score,6)+0e0 AS score FROM
 (SELECT *, count(*) FILTER (learn) OVER (PARTITION BY entity, fold) AS nl FROM w_vd) WHERE nl>=36 AND pos>=fold""", "w_vd"))
def wf_rules(spark, sf):
    v = P.enough(P.refit(spark, sf)[3], ["entity", "fold"])
    return C.rounded(v.filter(F.col("pos") >= F.col("fold")).select("entity", "fold", "month", "verdict", "score"))


# sensitivity: learn share x threshold, graded on the same (test) rows
SHARES, THRS = (0.4, 0.5, 0.6, 0.7), (0.5, 1.0, 1.5, 2.0, 2.5)
_T = ",".join(f"({t}e0)" for t in THRS)
cte("s3a", " UNION ALL ".join(
    f"""SELECT f.entity, f.month, f.pos, f.feature, f.x, f.y, f.part, {s}e0 AS share, f.y IS NOT NULL AND f.pos < CAST(floor(n_ev*{s}e0) AS INTEGER)-3 AS learn
 FROM fl f JOIN (SELECT DISTINCT entity, n_ev FROM fw) USING (entity)""" for s in SHARES), "fl", "fw")
cte("s3", "SELECT * FROM (SELECT *, count(*) FILTER (learn) OVER (PARTITION BY entity, share, feature) AS nl FROM s3a) WHERE nl>=36", "s3a", held=True)
state_ctes("g", "s3", "entity, share")
stat_ctes("g", "g_st", "entity, share")
cte("h_st", f"SELECT s.*, thr FROM g_st s CROSS JOIN (VALUES {_T}) v(thr)", "g_st")
cte("h_rl", f"SELECT b.*, thr, sign(round(edge,12))*1e0 AS weight FROM g_bq b CROSS JOIN (VALUES {_T}) v(thr) WHERE abs(t)>=thr AND round(edge,12)<>0", "g_bq")
verdict_ctes("h", "entity, share, thr")


@query("sensitivity_grid", sql("""SELECT entity, share, thr, CASE WHEN nf>=3 AND nu>=3 THEN round(d,6)+0e0 END AS spread FROM (
 SELECT entity, share, thr, count(*) FILTER (verdict='Favorable') AS nf, count(*) FILTER (verdict='Unfavorable') AS nu,
 (avg(y) FILTER (verdict='Favorable')-avg(y) FILTER (verdict='Unfavorable'))*100 AS d FROM h_vd WHERE part='test' GROUP BY ALL)""", "h_vd"))
def sensitivity_grid(spark, sf):
    fw = P.feature_frame(spark, sf)
    fl = T.long_form(fw, V.FEATURES, ("entity", "month", "pos", "y", "part", "n_ev"))
    fl = fl.withColumn("share", F.explode(F.array(*[F.lit(s) for s in SHARES])))
    cut = F.floor(F.col("n_ev") * F.col("share")).cast("int")
    fl = P.enough(fl.withColumn("learn", F.col("y").isNotNull() & (F.col("pos") < cut - V.H)), ["entity", "share", "feature"])
    st = S.tercile_states(fl, ["entity", "share", "feature"], F.col("learn"))
    bs = S.bucket_stats(st.filter("learn"), ["entity", "share"], V.H)
    thr = F.explode(F.array(*[F.lit(t) for t in THRS]))
    rules = S.select_rules(bs.withColumn("thr", thr).filter(F.abs("t") >= F.col("thr")), S.RuleConfig(threshold=0.0))
    keys = ["entity", "share", "thr"]
    sc = S.rule_scores(st.withColumn("thr", thr), rules, keys, ("y", "learn", "part"))
    v = S.verdicts(sc, keys, F.col("learn"))
    return C.rounded(S.favorable_spread(v.filter(F.col("part") == "test"), keys).drop("n_fav", "n_unf"))


cte("last_state", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY pos DESC) AS rn FROM a_st) WHERE rn=1", "a_st")


def latest(df, keys, cols):
    """Values of the last row per key, as one aggregate."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "pos").alias("z")).select(*keys, "z.*")


@query("flip_levels", sql("""SELECT entity, feature, state, CASE WHEN weight>0 THEN 'helps' ELSE 'hurts' END AS effect, """ + R("x", "lo", "hi", digits=8) + """,
 CASE state WHEN 'Low' THEN 'rises above' WHEN 'High' THEN 'falls below' ELSE 'leaves range' END AS flip
 FROM last_state JOIN (SELECT entity, feature, state, weight FROM a_rl) USING (entity, feature, state)""", "last_state", "a_rl"))
def flip_levels(spark, sf):
    st, _, rules, _ = P.learned(spark, sf)
    now = latest(st, ["entity", "feature"], ["state", "x", "lo", "hi"])
    on = ["entity", "feature", "state"]
    j = now.join(rules.select(*on, "weight"), on)
    return C.rounded(
        j.withColumn("effect", F.when(F.col("weight") > 0, "helps").otherwise("hurts"))
        .withColumn("flip", F.when(F.col("state") == "Low", "rises above").when(F.col("state") == "High", "falls below").otherwise("leaves range"))
        .drop("weight"),
        8,
    )


EXPLORE = (1, 3, 6, 12)
cte("expl", " UNION ALL ".join(f"SELECT entity, pos, {h} AS horizon, lead(px,{h}) OVER (PARTITION BY entity ORDER BY pos)/px-1e0 AS yh FROM fw" for h in EXPLORE), "fw")
cte("dd6", """SELECT f.entity, f.pos, CASE WHEN count(*)=4 THEN min(x/top-1e0) END AS dd FROM fw f JOIN (
  SELECT a.entity, a.pos, b.px AS x, max(b.px) OVER (PARTITION BY a.entity, a.pos ORDER BY b.pos) AS top
  FROM fw a JOIN fw b ON a.entity=b.entity AND b.pos BETWEEN a.pos AND a.pos+3) USING (entity,pos) GROUP BY ALL""", "fw")


@query("state_explorer", sql("""SELECT entity, feature, state, CAST(horizon AS INTEGER) AS horizon, n, """ + R("avg_y", "win", "base", "med_dd") + """ FROM (
 SELECT s.entity, s.feature, s.state, horizon, count(yh) AS n, avg(yh) AS avg_y, avg(CASE WHEN yh>0 THEN 1e0 WHEN yh IS NOT NULL THEN 0e0 END) AS win, any_value(base) AS base,
 quantile_cont(dd,0.5) AS med_dd
 FROM a_st s JOIN expl e USING (entity,pos) JOIN dd6 USING (entity,pos)
 JOIN (SELECT entity, horizon, avg(yh) AS base FROM expl JOIN fw USING (entity,pos) WHERE part<>'test' GROUP BY ALL) b USING (entity, horizon)
 WHERE s.part<>'test' AND s.state IS NOT NULL GROUP BY ALL)""", "a_st", "expl", "dd6", "fw"))
def state_explorer(spark, sf):
    """Outcome after every state of every indicator at several horizons; the final test rows stay hidden."""
    from pyspark.sql import Window

    w = C.by_entity("entity")
    fw = P.feature_frame(spark, sf).withColumn("dd", T.forward_drawdown("px", V.H, w))
    fw = fw.withColumn("yh", F.array(*[C.forward_return("px", h, w) for h in EXPLORE]))
    fl = T.long_form(fw, V.FEATURES, ("entity", "pos", "part", "yh", "dd"))
    st = S.tercile_states(fl, ["entity", "feature"], F.col("part") == "learn").filter(F.col("part") != "test")
    base = [F.avg(F.get("yh", F.lit(i))).over(Window.partitionBy("entity", "feature")) for i in range(len(EXPLORE))]
    items = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.get("yh", F.lit(i)).alias("yh"), F.col(f"b{i}").alias("base")) for i, h in enumerate(EXPLORE)]
    )
    st = st.select("*", *[b.alias(f"b{i}") for i, b in enumerate(base)]).filter(F.col("state").isNotNull())
    st = st.select("entity", "feature", "state", "dd", F.explode(items).alias("o")).select("entity", "feature", "state", "dd", "o.*")
    y = F.col("yh")
    return C.rounded(
        st.groupBy("entity", "feature", "state", "horizon").agg(
            F.count(y).alias("n"),
            F.avg(y).alias("avg_y"),
            F.avg((y > 0).cast("double")).alias("win"),
            F.first("base").alias("base"),
            F.percentile("dd", 0.5).alias("med_dd"),
        )
    )


@query("multiple_testing", sql("SELECT entity, count(*) AS tests, count(*) FILTER (abs(t)>=1.5) AS passes, "
    + R("count(*)*" + erfc_sql("1.5e0/sqrt(2e0)") + " AS by_luck") + ", count(*) FILTER (q<=0.10) AS q10, count(*) FILTER (q<=0.25) AS q25, "
    "array_to_string(list_slice(list(feature||':'||state ORDER BY q, p, feature, state),1,8), ',') AS best FROM a_bq GROUP BY entity", "a_bq"))
def multiple_testing(spark, sf):
    _, bs, _, _ = P.learned(spark, sf)
    best = F.array_sort(F.collect_list(F.struct("q", "p", "feature", "state")))
    return C.rounded(
        bs.groupBy("entity").agg(
            F.count(F.lit(1)).alias("tests"),
            F.count(F.when(F.abs("t") >= 1.5, 1)).alias("passes"),
            (F.count(F.lit(1)) * C.erfc_pos(F.lit(1.5) / F.sqrt(F.lit(2.0)))).alias("by_luck"),
            F.count(F.when(F.col("q") <= 0.10, 1)).alias("q10"),
            F.count(F.when(F.col("q") <= 0.25, 1)).alias("q25"),
            F.array_join(F.transform(F.slice(best, 1, 8), lambda b: F.concat_ws(":", b["feature"], b["state"])), ",").alias("best"),
        )
    )
