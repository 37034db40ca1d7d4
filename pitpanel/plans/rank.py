"""Indicator ranking queries (group I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rank as K
from ..operators import stats as ST
from ..operators import states as S
from ..operators import targets as T
from ..sources import views as V
from . import common as P
from .registry import R, cte, erfc_sql, query, sql
from .rules import HORIZONS
from .stats import ic_cte

PILLAR = {"disc": "price", "tax": "price", "ret_d3": "flow", "qty_c3": "flow", "px_m6": "trend", "px_t10": "trend"}
SIGN = {"disc": -1, "tax": -1, "ret_d3": -1, "qty_c3": 1, "px_m6": 1, "px_t10": 0}
cte("meta", "SELECT * FROM (VALUES " + ",".join(f"('{f}','{PILLAR[f]}',{SIGN[f]})" for f in PILLAR) + ") t(feature,pillar,sgn)")


def meta(spark):
    """Indicator dimension: pillar and textbook sign (the catalogue, a few rows)."""
    return F.broadcast(spark.createDataFrame([(f, PILLAR[f], SIGN[f]) for f in PILLAR], "feature string, pillar string, sgn int"))


cte("hl", """SELECT s.*, dd, CASE WHEN part='learn' THEN 'learn' ELSE 'unseen' END AS period FROM a_st s JOIN dd6 USING (entity,pos) WHERE part IN ('learn','val','test')""", "a_st", "dd6")


@query("hl_spread", sql("""SELECT entity, feature, period, """ + R("CASE WHEN ok THEN g*100 END AS hl", "CASE WHEN ok AND sd>0 THEN g/sd END AS eff", "CASE WHEN ok THEN dg*100 END AS hl_dd") + """ FROM (
 SELECT entity, feature, period, count(*) FILTER (state='High')>=4 AND count(*) FILTER (state='Low')>=4 AS ok, avg(y) FILTER (state='High')-avg(y) FILTER (state='Low') AS g, stddev_samp(y) AS sd,
 quantile_cont(dd,0.5) FILTER (state='High')-quantile_cont(dd,0.5) FILTER (state='Low') AS dg FROM hl GROUP BY ALL)""", "hl"))
def hl_spread(spark, sf):
    w = C.by_entity("entity")
    fw = P.feature_frame(spark, sf).withColumn("dd", T.forward_drawdown("px", V.H, w))
    fl = T.long_form(fw, V.FEATURES, ("entity", "pos", "y", "dd", "part"))
    st = S.tercile_states(fl, ["entity", "feature"], F.col("part") == "learn").filter(F.col("part").isin("learn", "val", "test"))
    st = st.withColumn("period", F.when(F.col("part") == "learn", "learn").otherwise("unseen"))
    return C.rounded(K.high_low(st, ["entity", "feature", "period"], "y", "dd"))


ic_cte("icl", "fl", "entity, feature", where="part='learn'")
ic_cte("icu", "fl", "entity, feature", where="part IN ('val','test')")
cte("irk", """SELECT entity, feature, l.ic AS ic_l, u.ic AS ic_u, CASE WHEN l.n>8 THEN t END AS t, coalesce(sign(l.ic)=sign(u.ic),false) AS same, u.n AS n_u
 FROM icl l JOIN icu u USING (entity,feature) JOIN hr_t USING (entity,feature)""", "icl", "icu", "hr_t")
cte("med", "SELECT entity, feature, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM fl WHERE part='learn' GROUP BY 1,2", "fl")
cte("hits", """SELECT entity, feature, count(*) AS n_ok, avg(CASE WHEN sign(x-mx)*sign(ic_l)=sign(y-my) THEN 1e0 ELSE 0e0 END) AS hit FROM fl JOIN med USING (entity,feature) JOIN irk USING (entity,feature)
 WHERE part IN ('val','test') AND sign(x-mx)<>0 AND sign(y-my)<>0 AND ic_l<>0 AND n_u>=8 GROUP BY 1,2 HAVING count(*)>=8""", "fl", "med", "irk")
cte("ranking", """SELECT i.*, hit, CASE WHEN hit IS NOT NULL THEN 1.96e0*sqrt(0.25e0/greatest(n_ok/3e0,1e0)) END AS hit_ci, CASE WHEN same THEN least(abs(ic_l),abs(ic_u))*100 ELSE 0e0 END AS minic,
 CASE WHEN ic_l IS NULL OR ic_u IS NULL THEN '-' WHEN NOT same THEN 'flips on unseen data' WHEN abs(t)>=2 THEN 'consistent and significant' ELSE 'consistent but weak' END AS status
 FROM irk i LEFT JOIN hits USING (entity,feature)""", "irk", "hits")
RANK_OUT = ("ic_l", "ic_u", "t", "hit", "hit_ci", "minic")


def ranking(spark, sf):
    fl = P.feature_long(spark, sf)
    fl = fl.withColumn("learn", F.col("part") == "learn").withColumn("unseen", F.col("part").isin("val", "test"))
    return K.indicator_ranking(fl, V.H)


@query("indicator_ranking", sql("SELECT entity, feature, same, status, " + R(*RANK_OUT)
    + ", CAST(row_number() OVER (PARTITION BY entity ORDER BY round(minic,9) DESC, round(abs(ic_l),9) DESC NULLS LAST, feature) AS INTEGER) AS place FROM ranking", "ranking"))
def indicator_ranking(spark, sf):
    order = [F.desc(F.round("minic", 9)), F.round(F.abs("ic_l"), 9).desc_nulls_last(), "feature"]
    return C.rounded(K.placed(ranking(spark, sf), ["entity"], order))


@query("pillar_rollup", sql("SELECT entity, pillar, count(*) AS n, " + R("avg(minic) AS mean_ic", "max(minic) AS max_ic") + " FROM ranking JOIN meta USING (feature) GROUP BY entity, pillar", "ranking", "meta"))
def pillar_rollup(spark, sf):
    r = ranking(spark, sf).join(meta(spark), "feature")
    return C.rounded(r.groupBy("entity", "pillar").agg(F.count(F.lit(1)).alias("n"), F.avg("minic").alias("mean_ic"), F.max("minic").alias("max_ic")))


cte("icp", f"SELECT *, {erfc_sql('abs(t)/sqrt(2e0)')} AS p FROM irk", "irk")
cte("icq", "SELECT *, least(min(p*m/k) OVER (PARTITION BY entity ORDER BY k DESC),1e0) AS q FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS m, row_number() OVER (PARTITION BY entity ORDER BY p, feature) AS k FROM icp)", "icp")


@query("ic_fdr", sql("SELECT entity, feature, " + R("ic_l", "p", "q") + ", CASE WHEN sgn=0 OR ic_l IS NULL THEN NULL ELSE sign(ic_l)=sgn END AS textbook FROM icq JOIN meta USING (feature)", "icq", "meta"))
def ic_fdr(spark, sf):
    r = ranking(spark, sf).withColumn("p", C.two_sided_p("t"))
    r = ST.bh_q(r, ["entity"], "p", ("feature",)).join(meta(spark), "feature")
    match = F.when((F.col("sgn") != 0) & F.col("ic_l").isNotNull(), F.signum("ic_l") == F.col("sgn"))
    return C.rounded(r.select("entity", "feature", "ic_l", "p", "q", match.alias("textbook")))


cte("hz", " UNION ALL ".join(f"SELECT entity, feature, pos, x, {h} AS horizon, lead(px,{h}) OVER (PARTITION BY entity, feature ORDER BY pos)/px-1e0 AS y FROM (SELECT f.*, fw.px FROM fl f JOIN fw USING (entity,pos))" for h in HORIZONS), "fl", "fw")
cte("hzl", "SELECT * FROM (SELECT *, count(y) OVER (PARTITION BY entity, feature, horizon) AS nh FROM hz) WHERE y IS NOT NULL AND pos < CAST(floor(nh*0.6e0) AS INTEGER)-horizon", "hz")
ic_cte("ich", "hzl", "entity, feature, horizon")


@query("ic_by_horizon", sql("SELECT entity, feature, CAST(horizon AS INTEGER) AS horizon, n, " + R("ic") + " FROM ich", "ich"))
def ic_by_horizon(spark, sf):
    """Learn-only rank correlation at every look-ahead; the horizon is a key, not a loop."""
    w = C.by_entity("entity")
    each = [F.struct(F.lit(h).alias("horizon"), C.forward_return("px", h, w).alias("yh")) for h in HORIZONS]
    fw = P.feature_frame(spark, sf).withColumn("o", F.array(*each))
    fw = fw.select("entity", "pos", *V.FEATURES, F.explode("o").alias("o")).select("entity", "pos", *V.FEATURES, "o.horizon", "o.yh")
    n = F.count("yh").over(Window.partitionBy("entity", "horizon"))
    fw = fw.withColumn("_n", n).filter(F.col("yh").isNotNull() & (F.col("pos") < F.floor(F.col("_n") * F.lit(V.TRAIN)) - F.col("horizon")))
    fl = T.long_form(fw, V.FEATURES, ("entity", "horizon", "pos", "yh"))
    return C.rounded(ST.rank_ic(fl, ["entity", "feature", "horizon"], "x", "yh"))


@query("top_environments", sql("""SELECT entity, list, CAST(place AS INTEGER) AS place, feature, state, n, round(edge,6)+0e0 AS edge FROM (
 SELECT 'best' AS list, *, row_number() OVER (PARTITION BY entity ORDER BY round(edge,12) DESC, feature, state) AS place FROM a_bq UNION ALL
 SELECT 'worst', *, row_number() OVER (PARTITION BY entity ORDER BY round(edge,12), feature, state) FROM a_bq) WHERE place<=6""", "a_bq"))
def top_environments(spark, sf):
    _, bs, _, _ = P.learned(spark, sf)
    t = K.top_bottom(bs, ["entity"], F.round("edge", 12), 6, ("feature", "state"))
    return C.rounded(t.select("entity", "list", "place", "feature", "state", "n", "edge"))


@query("env_matrix", sql("SELECT entity, feature, " + ", ".join(
    f"round(max(avg) FILTER (state='{s}'),6)+0e0 AS avg_{s.lower()}, max(n) FILTER (state='{s}') AS n_{s.lower()}" for s in S.STATES) + " FROM a_bq GROUP BY 1,2", "a_bq"))
def env_matrix(spark, sf):
    _, bs, _, _ = P.learned(spark, sf)
    wide = bs.groupBy("entity", "feature").pivot("state", list(S.STATES)).agg(F.first("avg").alias("avg"), F.first("n").alias("n"))
    cols = [F.col(f"{s}_{m}").alias(f"{m}_{s.lower()}") for s in S.STATES for m in ("avg", "n")]
    return C.rounded(wide.select("entity", "feature", *cols))
