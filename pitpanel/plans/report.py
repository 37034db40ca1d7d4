"""Decision-table queries (group O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analogue as N
from ..operators import model as M
from ..operators import report as RP
from ..operators import solve as SV
from ..operators import states as S
from ..operators import stats as ST
from ..operators import targets as T
from ..sources import views as V
from ..sources.store import materialise
from . import common as P
from .backtest import _E
from .linear_sql import logit_ctes, logit_p
from .model import probabilities
from .registry import R, cte, query, sql
from .rules import chain_ctes, latest, market, percentiles
from .stats import ci_ctes

LABEL = "CASE WHEN e>=0.99 THEN 'Favorable' WHEN e>=0.7 THEN 'Leaning favorable' WHEN e>0.3 THEN 'Neutral' WHEN e>0.01 THEN 'Leaning unfavorable' ELSE 'Unfavorable' END"
cte("two_v", """SELECT a.entity, a.month, a.pos, a.verdict, CASE WHEN p-base<=-0.05e0 THEN 'Unfavorable' WHEN p-base>=0.05e0 THEN 'Favorable' ELSE 'Neutral' END AS mlv FROM a_vd a JOIN prob9 USING (entity, pos)""", "a_vd", "prob9")
cte("expo", f"SELECT *, ({_E.format('verdict')}+{_E.format('mlv')})/2e0 AS e FROM two_v", "two_v")


def two_verdicts(spark, sf):
    d = probabilities(spark, sf)
    return d.withColumn("ml", M.ml_verdict(F.col("p"), F.col("base"), 0.05))


@query("exposure_label", sql(f"SELECT entity, month, round(e,6)+0e0 AS e, {LABEL} AS label FROM expo", "expo"))
def exposure_label(spark, sf):
    d = two_verdicts(spark, sf)
    e = (RP.exposure(F.col("verdict")) + RP.exposure(F.col("ml"))) / 2.0
    return C.rounded(d.select("entity", "month", e.alias("e"), RP.exposure_label(e).alias("label")))


cte("un", "SELECT entity, verdict, pos, y FROM a_vd WHERE part IN ('val','test')", "a_vd")
ci_ctes("unc", "un", "entity, verdict", 3, 1000)
cte("evid", """SELECT n.entity, coalesce(nr,0) AS n_rules, n_fav, n_unf, spread, f.lo AS lo_fav, u.hi AS hi_unf FROM (SELECT entity, count(*) FILTER (verdict='Favorable') AS n_fav, count(*) FILTER (verdict='Unfavorable') AS n_unf,
 (avg(y) FILTER (verdict='Favorable')-avg(y) FILTER (verdict='Unfavorable'))*100 AS spread FROM un GROUP BY 1) n LEFT JOIN (SELECT entity, count(*) AS nr FROM a_rl GROUP BY 1) r ON r.entity=n.entity
 LEFT JOIN unc_ci f ON f.entity=n.entity AND f.verdict='Favorable' LEFT JOIN unc_ci u ON u.entity=n.entity AND u.verdict='Unfavorable'""", "un", "a_rl", "unc_ci")
cte("evl", "SELECT *, CASE WHEN n_rules=0 THEN 'None' WHEN n_fav<3 OR n_unf<3 THEN 'Unknown' WHEN spread>2 AND coalesce(lo_fav>hi_unf,false) THEN 'Strong' WHEN spread>0 THEN 'Weak' ELSE 'None' END AS level FROM evid", "evid")


def evidence(rules, scored, keys=("entity",)):
    """Evidence level per key on the unseen rows."""
    keys = list(keys)
    unseen = scored.filter(F.col("part").isin("val", "test"))
    sp = S.favorable_spread(unseen, keys)
    ci = ST.block_ci(unseen, [*keys, "verdict"], "y", V.H, 1000)
    edge = ci.groupBy(*keys).agg(
        F.max(F.when(F.col("verdict") == S.FAV, F.col("lo"))).alias("lo_fav"), F.max(F.when(F.col("verdict") == S.UNF, F.col("hi"))).alias("hi_unf")
    )
    n = rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rules"))
    d = sp.join(edge, keys, "left").join(n, keys, "left").fillna(0, ["n_rules"])
    return d.withColumn("level", RP.evidence_level(*[F.col(c) for c in ("n_rules", "n_fav", "n_unf", "spread", "lo_fav", "hi_unf")]))


@query("evidence_level", sql("SELECT entity, n_rules, n_fav, n_unf, CASE WHEN n_fav>=3 AND n_unf>=3 THEN round(spread,6)+0e0 END AS spread, " + R("lo_fav", "hi_unf") + ", level FROM evl", "evl"))
def evidence_level(spark, sf):
    _, _, rules, sc = P.learned(spark, sf)
    return C.rounded(evidence(rules, sc))


cte("anas", "SELECT entity, median(after) AS med, avg(CASE WHEN after>0 THEN 1e0 ELSE 0e0 END) AS share FROM ana GROUP BY 1", "ana")
_VT = "CASE {} WHEN 'Favorable' THEN 1 WHEN 'Unfavorable' THEN -1 ELSE 0 END"
cte("read0", f"""SELECT e.entity, e.verdict, e.mlv, e.e, med, share, {_VT.format('e.verdict')}+{_VT.format('e.mlv')}+CASE WHEN med>0 AND share>=0.55 THEN 1 WHEN med<0 AND share<=0.45 THEN -1 ELSE 0 END AS tot,
 CASE WHEN px_t10>0 THEN 1 ELSE -1 END AS trend, level FROM (SELECT * FROM expo QUALIFY pos=max(pos) OVER (PARTITION BY entity)) e JOIN anas USING (entity) JOIN evl USING (entity) JOIN fw ON fw.entity=e.entity AND fw.pos=e.pos""", "expo", "anas", "evl", "fw")
cte("read1", "SELECT *, CASE WHEN tot>=2 THEN 1 WHEN tot<=-2 THEN -1 ELSE 0 END AS macro FROM read0", "read0")
CONF = "CASE WHEN macro=0 OR macro<>trend THEN 'Low' WHEN level='Strong' THEN 'High' WHEN level='Weak' THEN 'Medium' ELSE 'Low' END"


def current(spark, sf):
    """All channels of the latest row per entity."""
    st, _, rules, sc = P.learned(spark, sf)
    now = latest(two_verdicts(spark, sf), ["entity"], ["month", "verdict", "ml", "score"])
    fw = P.feature_frame(spark, sf)
    ana = N.analogues(fw, V.FEATURES, V.H).groupBy("entity").agg(
        F.percentile("after", 0.5).alias("med"), F.avg((F.col("after") > 0).cast("double")).alias("share")
    )
    trend = fw.groupBy("entity").agg(F.max_by(F.when(F.col("px_t10") > 0, 1).otherwise(-1), "pos").alias("trend"))
    d = now.join(ana, "entity").join(trend, "entity").join(evidence(rules, sc).select("entity", "level"), "entity")
    total = RP.vote(F.col("verdict")) + RP.vote(F.col("ml")) + RP.analogue_vote(F.col("med"), F.col("share"))
    d = d.withColumn("macro", RP.macro_vote(total))
    return d.withColumn("confidence", RP.confidence(F.col("macro"), F.col("trend"), F.col("level"))), st, rules


@query("confidence", sql(f"SELECT entity, verdict, mlv AS ml, CAST(macro AS INTEGER) AS macro, CAST(trend AS INTEGER) AS trend, level, {CONF} AS confidence FROM read1", "read1"))
def confidence(spark, sf):
    d, _, _ = current(spark, sf)
    return d.select("entity", "verdict", "ml", "macro", "trend", "level", "confidence")


cte("why", """SELECT entity, list(feature||':'||state ORDER BY feature) FILTER (weight>0) AS good, list(feature||':'||state ORDER BY feature) FILTER (weight<0) AS bad
 FROM last_state JOIN (SELECT entity, feature, state, weight FROM a_rl) USING (entity, feature, state) GROUP BY 1""", "last_state", "a_rl")


@query("current_read", sql(f"""SELECT r.entity, verdict, mlv AS ml, {LABEL} AS label, level, {CONF} AS confidence, coalesce(array_to_string(good,','),'') AS helping, coalesce(array_to_string(bad,','),'') AS hurting, """
    + R("e", "med", "share") + " FROM read1 r LEFT JOIN why USING (entity)", "read1", "why"))
def current_read(spark, sf):
    d, st, rules = current(spark, sf)
    on = ["entity", "feature", "state"]
    active = latest(st, ["entity", "feature"], ["state"]).join(rules.select(*on, "weight"), on)
    tag = F.concat_ws(":", "feature", "state")
    names = lambda sign: F.array_join(F.array_sort(F.collect_list(F.when(F.col("weight") * sign > 0, tag))), ",")
    why = active.groupBy("entity").agg(names(1).alias("helping"), names(-1).alias("hurting"))
    e = (RP.exposure(F.col("verdict")) + RP.exposure(F.col("ml"))) / 2.0
    d = d.join(why, "entity", "left").fillna("", ["helping", "hurting"]).withColumn("e", e).withColumn("label", RP.exposure_label(e))
    return C.rounded(d.select("entity", "verdict", "ml", "label", "level", "confidence", "helping", "hurting", "e", "med", "share"))


# --------------------------------------------------------------------------- the read of all targets
FLOOR, VOL_TARGET = 0.30, 0.5
cte("tgw", f"SELECT entity, month, y AS a_return, y*coalesce(CASE WHEN vol IS NOT NULL AND vol<>0 THEN least(greatest({VOL_TARGET}e0/vol,0.25e0),2e0) END,1e0) AS a_vol, y-y2 AS a_rel, y-coalesce(pow(1e0+irx/100e0,0.25e0)-1e0,0e0) AS a_cash FROM r2", "r2")
_TY = {"return": "a_return", "vol-scaled": "a_vol", "drawdown": f"dd+{FLOOR}e0", "relative": "a_rel", "cash": "a_cash"}
_FE = ", ".join("f." + c for c in V.FEATURES)
cte("tg", " UNION ALL ".join(f"SELECT f.entity, f.month, f.pos, f.part, f.px_t10>0 AS up, {_FE}, '{k}' AS target, {v} AS y FROM fw f JOIN tgw USING (entity, month) JOIN dd6 USING (entity, pos)" for k, v in _TY.items()), "fw", "tgw", "dd6", held=True)
cte("tgl", " UNION ALL ".join(f"SELECT entity, target, month, pos, '{c}' AS feature, {c} AS x, y, part, part='learn' AS learn FROM tg" for c in V.FEATURES), "tg", held=True)
chain_ctes("t", "tgl", "entity, target")
cte("tun", "SELECT entity, target, verdict, pos, y FROM t_vd WHERE part IN ('val','test')", "t_vd", held=True)
ci_ctes("tuc", "tun", "entity, target, verdict", 3, 1000)
cte("tev", """SELECT n.entity, n.target, coalesce(nr,0) AS n_rules, n_fav, n_unf, spread, f.lo AS lo_fav, u.hi AS hi_unf FROM (SELECT entity, target, count(*) FILTER (verdict='Favorable' AND y IS NOT NULL) AS n_fav, count(*) FILTER (verdict='Unfavorable' AND y IS NOT NULL) AS n_unf,
 (avg(y) FILTER (verdict='Favorable')-avg(y) FILTER (verdict='Unfavorable'))*100 AS spread FROM tun GROUP BY 1,2) n LEFT JOIN (SELECT entity, target, count(*) AS nr FROM t_rl GROUP BY 1,2) r USING (entity, target)
 LEFT JOIN (SELECT * FROM tuc_ci WHERE verdict='Favorable') f USING (entity, target) LEFT JOIN (SELECT * FROM tuc_ci WHERE verdict='Unfavorable') u USING (entity, target)""", "tun", "t_rl", "tuc_ci")
cte("tlv", "SELECT entity, target, CASE WHEN n_rules=0 THEN 'None' WHEN n_fav<3 OR n_unf<3 THEN 'Unknown' WHEN spread>2 AND coalesce(lo_fav>hi_unf,false) THEN 'Strong' WHEN spread>0 THEN 'Weak' ELSE 'None' END AS level FROM tev", "tev")
cte("tnow", "SELECT *, y IS NOT NULL AS learn, pos=max(pos) OVER (PARTITION BY entity, target) AS last FROM tg", "tg", held=True)
logit_ctes("tl", "tnow", "entity, target", V.FEATURES, min_rows=2)
cte("tml", f"SELECT entity, target, pos, up, coalesce({logit_p(V.FEATURES)},0.5e0) AS p, coalesce(base,0.5e0) AS base FROM tnow LEFT JOIN tl_fit USING (entity, target) WHERE last", "tnow", "tl_fit")
cte("tan", "SELECT a.entity, target, median(y) AS med, avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) AS share FROM ana a JOIN tg USING (entity, pos) GROUP BY 1,2", "ana", "tg")
cte("tr0", f"""SELECT v.entity, v.target, v.verdict, CASE WHEN round(p,9)-base<=-0.05e0 THEN 'Unfavorable' WHEN round(p,9)-base>=0.05e0 THEN 'Favorable' ELSE 'Neutral' END AS mlv, med, share, CASE WHEN up THEN 1 ELSE -1 END AS trend, level
 FROM t_vd v JOIN tml USING (entity, target, pos) JOIN tan USING (entity, target) JOIN tlv USING (entity, target)""", "t_vd", "tml", "tan", "tlv", held=True)
cte("tr1", f"""SELECT *, CASE WHEN tot>=2 THEN 1 WHEN tot<=-2 THEN -1 ELSE 0 END AS macro FROM (SELECT *, ({_E.format('verdict')}+{_E.format('mlv')})/2e0 AS e, {_VT.format('verdict')}+{_VT.format('mlv')}+CASE WHEN med>0 AND share>=0.55 THEN 1 WHEN med<0 AND share<=0.45 THEN -1 ELSE 0 END AS tot FROM tr0)""", "tr0")
cte("twhy", """SELECT entity, target, list(feature||':'||state ORDER BY feature) FILTER (weight>0) AS good, list(feature||':'||state ORDER BY feature) FILTER (weight<0) AS bad
 FROM (SELECT * FROM t_st QUALIFY pos=max(pos) OVER (PARTITION BY entity, target, feature)) JOIN (SELECT entity, target, feature, state, weight FROM t_rl) USING (entity, target, feature, state) GROUP BY 1,2""", "t_st", "t_rl")


def target_frame(spark, sf):
    """Feature rows once per target: return, scaled to constant volatility, drawdown above a floor, relative to the second asset, to cash."""
    w = C.by_entity("entity")
    m = market(spark, sf).select("entity", "month", "vol", "y2", F.col("y").alias("ym"), T.cash_rate("irx", 3).alias("rf"))
    f = P.feature_frame(spark, sf).withColumn("dd", T.forward_drawdown("px", V.H, w)).join(m, ["entity", "month"])
    y = F.col("ym")
    each = {"return": y, "vol-scaled": T.vol_scaled(y, F.col("vol"), VOL_TARGET), "drawdown": F.col("dd") + FLOOR, "relative": y - F.col("y2"), "cash": y - F.col("rf")}
    f = f.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("target"), v.alias("ty")) for k, v in each.items()])))
    return f.select("entity", "month", "pos", "part", *V.FEATURES, "_t.target", F.col("_t.ty").alias("y"))


@query("current_read_targets", sql(f"""SELECT r.entity, r.target, verdict, mlv AS ml, {LABEL} AS label, level, {CONF} AS confidence, coalesce(array_to_string(good,','),'') AS helping, coalesce(array_to_string(bad,','),'') AS hurting, """
    + R("e", "med", "share") + " FROM tr1 r LEFT JOIN twhy USING (entity, target)", "tr1", "twhy"))
def current_read_targets(spark, sf):
    """The latest read of every entity and target: rules, classifier fitted on all known rows, analogues, evidence and confidence."""
    keys = ["entity", "target"]
    rows = materialise(spark, sf, "targets", V.PANEL_TABLES, lambda: target_frame(spark, sf))
    long = T.long_form(rows, V.FEATURES, (*keys, "month", "pos", "y", "part")).withColumn("learn", F.col("part") == "learn")
    st, _, rules, sc = S.run_rules(long, keys, V.H, P.CFG, ("month", "y", "learn", "part"))
    now = latest(sc, keys, ["verdict"])
    ml = SV.latest_logit(rows.withColumn("learn", F.col("y").isNotNull()), V.FEATURES, keys).select(*keys, M.ml_verdict(F.round("p", 9), F.col("base"), 0.05).alias("ml")).distinct()
    picks = N.analogues(P.feature_frame(spark, sf), V.FEATURES, V.H).select("entity", "pos")
    ana = rows.join(picks, ["entity", "pos"]).groupBy(*keys).agg(F.percentile("y", 0.5).alias("med"), F.avg((F.col("y") > 0).cast("double")).alias("share"))
    trend = rows.groupBy(*keys).agg(F.max_by(F.when(F.col("px_t10") > 0, 1).otherwise(-1), "pos").alias("trend"))
    d = now.join(ml, keys).join(ana, keys).join(trend, keys).join(evidence(rules, sc, keys).select(*keys, "level"), keys)
    total = RP.vote(F.col("verdict")) + RP.vote(F.col("ml")) + RP.analogue_vote(F.col("med"), F.col("share"))
    d = d.withColumn("macro", RP.macro_vote(total)).withColumn("confidence", RP.confidence(F.col("macro"), F.col("trend"), F.col("level")))
    on = [*keys, "feature", "state"]
    active = latest(st, [*keys, "feature"], ["state"]).join(rules.select(*on, "weight"), on)
    tag = F.concat_ws(":", "feature", "state")
    names = lambda sign: F.array_join(F.array_sort(F.collect_list(F.when(F.col("weight") * sign > 0, tag))), ",")
    why = active.groupBy(*keys).agg(names(1).alias("helping"), names(-1).alias("hurting"))
    e = (RP.exposure(F.col("verdict")) + RP.exposure(F.col("ml"))) / 2.0
    d = d.join(why, keys, "left").fillna("", ["helping", "hurting"]).withColumn("e", e).withColumn("label", RP.exposure_label(e))
    return C.rounded(d.select(*keys, "verdict", "ml", "label", "level", "confidence", "helping", "hurting", "e", "med", "share"))


cte("stand", "SELECT *, lag(x,3) OVER (PARTITION BY entity, feature ORDER BY pos) AS x3 FROM a_st", "a_st")


@query("standings", sql("SELECT entity, feature, state, " + R("x", "x-x3 AS change", digits=8) + ", pit IS NOT NULL AND pit>=CAST(2 AS DOUBLE)/3 AS high FROM stand JOIN (SELECT entity, feature, pos, pit FROM pctl) USING (entity, feature, pos) QUALIFY pos=max(pos) OVER (PARTITION BY entity, feature)", "stand", "pctl"))
def standings(spark, sf):
    """Latest value, three-row change, state and whether it is in the top third of its history."""
    change = F.col("x") - F.lag("x", 3).over(C.by_entity("entity", "feature"))
    fl = percentiles(spark, sf).withColumn("change", change)
    st = S.tercile_states(fl, ["entity", "feature"], F.col("part") == "learn")
    now = latest(st, ["entity", "feature"], ["state", "x", "change", "pit"])
    return C.rounded(now.withColumn("high", F.coalesce(F.col("pit") >= 2 / 3, F.lit(False))).drop("pit"), 8)


cte("osym", "SELECT symbol, round(avg(strike),2) AS spot, coalesce(min(dte) FILTER (dte BETWEEN 14 AND 60), min(dte)) AS near_dte, min(dte) FILTER (dte BETWEEN 75 AND 200) AS far_dte FROM chain GROUP BY 1", "chain")


def _iv(kind, d, mult):
    return f"(SELECT iv*100e0 FROM chain c WHERE c.symbol=s.symbol AND c.type='{kind}' AND c.dte=s.{d} AND iv>0.01 AND oi+vol>0 ORDER BY round(abs(strike-spot*{mult}e0),9), strike, row_id LIMIT 1)"


cte("osum", "SELECT s.*, " + ", ".join(f"{_iv(k, d, m)} AS {n}" for n, k, d, m in (("cn", "call", "near_dte", 1.0), ("pn", "put", "near_dte", 1.0), ("pw", "put", "near_dte", 0.9), ("cw", "call", "near_dte", 1.1), ("cf", "call", "far_dte", 1.0), ("pf", "put", "far_dte", 1.0)))
    + ", " + ", ".join(f"(SELECT coalesce(sum({c}) FILTER (type='put'),0)/greatest(coalesce(sum({c}) FILTER (type='call'),0),1) FROM chain c WHERE c.symbol=s.symbol AND c.dte=s.near_dte) AS pc_{c}" for c in ("vol", "oi")) + " FROM osym s", "osym", "chain")
cte("osum2", "SELECT *, CASE WHEN cn IS NULL OR pn IS NULL THEN coalesce(cn,pn) ELSE (cn+pn)/2 END AS atm_near, CASE WHEN cf IS NULL OR pf IS NULL THEN coalesce(cf,pf) ELSE (cf+pf)/2 END AS atm_far, pw-cw AS skew FROM osum", "osum")


@query("option_summary", sql("""SELECT symbol, near_dte, far_dte, """ + R("spot", "pc_vol", "pc_oi", "atm_near", "atm_far", "skew", "atm_far-atm_near AS term") + """,
 CASE WHEN atm_far-atm_near < -1 THEN 'inverted' WHEN atm_far-atm_near>1 THEN 'normal' WHEN atm_far-atm_near IS NOT NULL THEN 'flat' END AS shape,
 CASE WHEN skew < -1 THEN 'calls richer' WHEN skew>1 THEN 'puts richer' WHEN skew IS NOT NULL THEN 'balanced' END AS wings FROM osum2""", "osum2"))
def option_summary(spark, sf):
    return C.rounded(RP.option_summary(V.option_chain(spark, sf)))
