"""Classifier queries (group J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import boosting as BO
from ..operators import forest as FO
from ..operators import model as M
from ..operators import solve as SV
from ..operators import states as S
from ..operators import stats as ST
from ..operators import targets as T
from ..sources import views as V
from . import common as P
from .linear_sql import logit_ctes, logit_p, logit_terms
from .registry import R, cte, query, sql
from .stats import CORR, ranks_sql, start_sql

FEATS = ", ".join(V.FEATURES)
cte("lf", f"""SELECT entity, month, pos, part, y, {FEATS}, fold, pos<fold-{V.H} AND y IS NOT NULL AS learn, pos>=fold AS graded
 FROM (SELECT *, CAST(unnest(generate_series(c1, n_all-1, {P.STEP})) AS INTEGER) AS fold FROM fw) WHERE (pos<fold-{V.H} AND y IS NOT NULL) OR (pos>=fold AND pos<fold+{P.STEP})""", "fw", held=True)
logit_ctes("lg", "lf", "entity, fold", V.FEATURES)
cte("prob9", f"SELECT entity, month, pos, part, y, fold, round({logit_p(V.FEATURES)},9) AS p, base FROM lf JOIN lg_fit USING (entity, fold) WHERE graded", "lf", "lg_fit", held=True)


def probabilities(spark, sf):
    """Rule score and verdict with the walk-forward probability of the classifier, for the rows from the validation start on."""
    sc = P.learned(spark, sf)[3]
    return sc.join(P.classified(spark, sf).select("entity", "pos", "p", "base"), ["entity", "pos"])


cte("pm_r", ranks_sql("prob9", "entity, part", "p", "y", "part IN ('val','test')"), "prob9")
cte("pm", f"""SELECT entity, part, count(*) AS n, (sum(rx) FILTER (l=1)-sum(l)*(sum(l)+1)/2)/nullif(sum(l)*(count(*)-sum(l)),0) AS auc, avg((pc-l)*(pc-l)) AS brier, avg((bc-l)*(bc-l)) AS bb,
 avg(-(l*ln(pc)+(1-l)*ln(1-pc))) AS log_loss, avg(CASE WHEN (p>0.5)=(l=1) THEN 1e0 ELSE 0e0 END) AS accuracy, greatest(avg(l),1-avg(l)) AS naive, CASE WHEN count(*)>=8 THEN {CORR} END AS ic
 FROM (SELECT *, CASE WHEN y>0 THEN 1e0 ELSE 0e0 END AS l, least(greatest(p,0.01e0),0.99e0) AS pc, least(greatest(base,0.01e0),0.99e0) AS bc FROM pm_r) GROUP BY 1,2""", "pm_r")


@query("prob_metrics", sql("SELECT entity, part, n, " + R("auc", "brier", "1e0-brier/bb AS skill", "log_loss", "accuracy", "naive", "ic") + " FROM pm", "pm"))
def prob_metrics(spark, sf):
    d = probabilities(spark, sf).filter(F.col("part").isin("val", "test"))
    return C.rounded(M.prob_metrics(d, ["entity", "part"]))


@query("ml_verdict", sql("""SELECT entity, month, CASE WHEN p-base<=-0.05e0 THEN 'Unfavorable' WHEN p-base>=0.05e0 THEN 'Favorable' ELSE 'Neutral' END AS verdict FROM prob9""", "prob9"))
def ml_verdict(spark, sf):
    d = probabilities(spark, sf)
    return d.select("entity", "month", M.ml_verdict(F.col("p"), F.col("base"), 0.05).alias("verdict"))


@query("known_rows", sql("SELECT entity, month, round(p,6)+0e0 AS p FROM prob9 WHERE y IS NOT NULL AND part='val'", "prob9"))
def known_rows(spark, sf):
    """Scored rows restricted to the validation rows whose outcome is known."""
    outcomes = P.feature_frame(spark, sf).filter(F.col("part") == "val")
    return C.rounded(M.known(probabilities(spark, sf), outcomes).select("entity", "month", "p"))


cte("cal_e", "SELECT entity, list_sort(list_distinct(quantile_cont(p,[0,0.2,0.4,0.6,0.8,1.0]))) AS e FROM prob9 WHERE y IS NOT NULL GROUP BY 1", "prob9")


@query("calibration", sql("""SELECT entity, CAST(bin AS INTEGER) AS bin, count(*) AS n, """ + R("avg(p) AS p_mean", "avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) AS share") + """ FROM (
 SELECT *, greatest(len(list_filter(e, lambda v: v<p)),1) AS bin FROM prob9 JOIN cal_e USING (entity) WHERE y IS NOT NULL) GROUP BY 1,2""", "prob9", "cal_e"))
def calibration(spark, sf):
    return C.rounded(M.calibration(probabilities(spark, sf), ["entity"]))


# bootstrap interval of the AUC: pairs resampled in blocks, ranks per replicate
cte("aucx", "SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY pos)-1 AS i, p, CASE WHEN y>0 THEN 1e0 ELSE 0e0 END AS l FROM prob9 WHERE part IN ('val','test')", "prob9")
cte("aucn", "SELECT entity, CAST(count(*) AS BIGINT) AS n FROM aucx GROUP BY 1", "aucx")
cte("aucd", f"""SELECT entity, rep, {start_sql('n-3+1', 'rep', 'k')}+o AS i FROM (SELECT entity, n, CAST(rep AS BIGINT) AS rep, CAST(k AS BIGINT) AS k, o FROM aucn, range(300) r(rep), range(60) q(k), range(3) z(o)
 WHERE k<ceil(n/3e0) AND k*3+o<n)""", "aucn")
cte("aucr", "SELECT entity, rep, l, rank() OVER (PARTITION BY entity, rep ORDER BY p)+(count(*) OVER (PARTITION BY entity, rep, p)-1)/2e0 AS r FROM aucd JOIN aucx USING (entity, i)", "aucd", "aucx")
cte("aucv", "SELECT entity, rep, (sum(r) FILTER (l=1)-sum(l)*(sum(l)+1)/2)/nullif(sum(l)*(count(*)-sum(l)),0) AS auc FROM aucr GROUP BY 1,2", "aucr")


@query("auc_ci", sql("""SELECT entity, count(auc) AS reps, CASE WHEN any_value(n)>=20 AND count(auc)>20 THEN round(quantile_cont(auc,0.025),6)+0e0 END AS lo,
 CASE WHEN any_value(n)>=20 AND count(auc)>20 THEN round(quantile_cont(auc,0.975),6)+0e0 END AS hi FROM aucv JOIN aucn USING (entity) GROUP BY 1""", "aucv", "aucn"))
def auc_ci(spark, sf, reps: int = 300, block: int = 3):
    """Replicates are weights on the original rows, so each needs one aggregate and no re-sorting of copies."""
    d = probabilities(spark, sf).filter(F.col("part").isin("val", "test"))
    w = Window.partitionBy("entity").orderBy("pos")
    d = d.select("entity", "p", (F.col("y") > 0).cast("double").alias("l"), (F.row_number().over(w) - 1).alias("i"))
    return C.rounded(ST.auc_ci(d, ["entity"], "p", "l", "i", block, reps))


WF_COLS = ("entity", "pos", "fold", "p", "base")


@query("wf_logit", sql("SELECT entity, pos, fold, " + R("p", "base") + " FROM prob9", "prob9"))
def wf_logit(spark, sf):
    return C.rounded(P.classified(spark, sf).select(*WF_COLS))


@query("wf_forest")
def wf_forest(spark, sf, trees: int = 300):
    """The same refits with forests: 300 trees of depth 3 with at least 10 rows in a leaf."""
    return C.rounded(FO.fold_forest(P.fold_frame(spark, sf), V.FEATURES, trees=trees).select(*WF_COLS))


@query("wf_boosting")
def wf_boosting(spark, sf, rounds: int = 100):
    """The same refits with boosting of the log loss: 100 trees of depth 2, rate 0.05, on 80 % of the rows each."""
    return C.rounded(BO.fold_classifier(P.fold_frame(spark, sf), V.FEATURES, ("entity",), rounds=rounds).select(*WF_COLS))


cte("now", f"SELECT entity, pos, y, {FEATS}, y IS NOT NULL AS learn, pos=max(pos) OVER (PARTITION BY entity) AS graded FROM fw", "fw", held=True)
logit_ctes("nl", "now", "entity", V.FEATURES, min_rows=2)
_TERMS = logit_terms(V.FEATURES)


@query("fit_latest", sql(" UNION ALL ".join(f"SELECT entity, '{f}' AS feature, round(coalesce(w[{i + 2}],0),6)+0e0 AS coef, round({_TERMS[i]},6)+0e0 AS contribution, round(coalesce({logit_p(V.FEATURES)},0.5e0),6)+0e0 AS p, round(coalesce(base,0.5e0),6)+0e0 AS base FROM now LEFT JOIN nl_fit USING (entity) WHERE graded" for i, f in enumerate(V.FEATURES)), "now", "nl_fit"))
def fit_latest(spark, sf):
    fw = P.feature_frame(spark, sf).withColumn("learn", F.col("y").isNotNull())
    return C.rounded(SV.latest_logit(fw, V.FEATURES))


@query("forest_importances")
def forest_importances(spark, sf, trees: int = 300):
    """Which indicators the forest fitted on all known rows splits by; shares that sum to one."""
    rows = P.feature_frame(spark, sf).filter("y is not null").withColumns({"learn": F.lit(True), "fold": F.lit(0)})
    return C.rounded(FO.importances(rows, V.FEATURES, min_rows=2, trees=trees).drop("fold"))


cte("abl", f"""SELECT entity, dropped, pos, part, y, fold, learn, graded, {", ".join(f"CASE WHEN dropped='{f}' THEN 0e0 ELSE {f} END AS {f}" for f in V.FEATURES)}
 FROM lf CROSS JOIN (VALUES {", ".join(f"('{v}')" for v in ("none", *V.FEATURES))}) v(dropped)""", "lf", held=True)
logit_ctes("al", "abl", "entity, dropped, fold", V.FEATURES)
cte("ablp", f"SELECT entity, dropped, part, y, round({logit_p(V.FEATURES)},9) AS p FROM abl JOIN al_fit USING (entity, dropped, fold) WHERE graded", "abl", "al_fit", held=True)
cte("ablr", ranks_sql("ablp", "entity, dropped", "p", "y", "part IN ('val','test')"), "ablp")
cte("ablm", f"SELECT entity, dropped, (sum(rx) FILTER (l=1)-sum(l)*(sum(l)+1)/2)/nullif(sum(l)*(count(*)-sum(l)),0) AS auc, CASE WHEN count(*)>=8 THEN {CORR} END AS ic FROM (SELECT *, CASE WHEN y>0 THEN 1e0 ELSE 0e0 END AS l FROM ablr) GROUP BY 1,2", "ablr", held=True)


@query("ablation", sql("SELECT a.entity, a.dropped, " + R("b.auc-a.auc AS d_auc", "b.ic-a.ic AS d_ic") + " FROM ablm a JOIN ablm b ON b.entity=a.entity AND b.dropped='none' WHERE a.dropped<>'none'", "ablm"))
def ablation(spark, sf):
    """AUC and rank correlation lost when one indicator is dropped; the dropped name is a key."""
    variants = ["none", *V.FEATURES]
    one = P.fold_frame(spark, sf).withColumn("dropped", F.explode(F.array(*[F.lit(v) for v in variants])))
    one = one.withColumns({f: F.when(F.col("dropped") == f, 0.0).otherwise(F.col(f)) for f in V.FEATURES})  # a constant input has no effect
    wf = SV.fold_logit(one, V.FEATURES, ["entity", "dropped", "fold"]).withColumn("p", F.round("p", 9))
    graded = wf.join(P.feature_frame(spark, sf).filter(F.col("part").isin("val", "test")).select("entity", "pos", "y"), ["entity", "pos"])
    m = M.prob_metrics(graded, ["entity", "dropped"])
    full = lambda c: F.max(F.when(F.col("dropped") == "none", F.col(c))).over(Window.partitionBy("entity"))
    m = m.withColumns({"d_auc": full("auc") - F.col("auc"), "d_ic": full("ic") - F.col("ic")})
    return C.rounded(m.filter(F.col("dropped") != "none").select("entity", "dropped", "d_auc", "d_ic"))


def pooled(kind: str):
    def run(spark, sf):
        """One classifier over all entities: fitted on learn rows, scored on the unseen ones."""
        fw = P.feature_frame(spark, sf)
        model = M.fit_pooled(fw.filter(F.col("part") == "learn"), V.FEATURES, kind)
        d = M.predict_pooled(model, fw.filter(F.col("part").isin("val", "test")))
        base = fw.filter(F.col("part") == "learn").groupBy("entity").agg(F.avg((F.col("y") > 0).cast("double")).alias("base"))
        return C.rounded(M.prob_metrics(d.join(base, "entity"), ["entity", "part"]))

    return run


for _kind in ("logistic", "forest", "boosting"):
    query(f"pooled_{_kind}")(pooled(_kind))


#: Look-aheads of the scan, and the rows to learn from and to validate on that a choice needs.
SCAN = (1, 2, 3, 6, 9, 12)
SCAN_LEARN, SCAN_VALID = 36, 10


@query("horizon_scan")
def horizon_scan(spark, sf):
    """Rule and classifier rank correlation per look-ahead inside the learn period, and the stable choice.

    Every entity has a row per look-ahead; its scores are null where there are fewer than SCAN_LEARN or SCAN_VALID rows.
    """
    w = C.by_entity("entity")
    fw = P.feature_frame(spark, sf)
    each = [F.struct(F.lit(h).alias("horizon"), C.forward_return("px", h, w).alias("yh")) for h in SCAN]
    fw = fw.withColumn("_o", F.array(*each)).withColumn("o", F.explode("_o"))
    fw = fw.select("entity", "pos", *V.FEATURES, "o.horizon", F.col("o.yh").alias("y"))
    h = F.col("horizon")
    n = F.count("y").over(Window.partitionBy("entity", "horizon"))
    size = F.greatest(F.floor(F.col("_n") * F.lit(0.85)) - h, F.lit(0))
    fw = fw.withColumn("_n", n).withColumn("_k", F.floor(size * F.lit(0.7)))
    keys = ["entity", "horizon"]
    fw = fw.withColumn("_in", F.col("y").isNotNull() & (F.col("pos") < size)).withColumn("learn", F.col("pos") < F.col("_k") - h)
    fw = fw.withColumn("valid", F.col("pos") >= F.col("_k"))
    sizes = fw.groupBy(*keys).agg(*[F.count(F.when(F.col("_in") & F.col(c), 1)).alias(a) for c, a in (("learn", "_a"), ("valid", "n_val"))])
    fw = fw.filter("_in").drop("_in").join(sizes.filter((F.col("_a") >= SCAN_LEARN) & (F.col("n_val") >= SCAN_VALID)).select(*keys), keys, "left_semi")
    fl = T.long_form(fw, V.FEATURES, ("entity", "horizon", "pos", "y", "learn", "valid"))
    rules = S.run_rules(fl, keys, "horizon", P.CFG, ("y", "learn", "valid"), most=max(SCAN))[3]
    half = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) > F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2)
    v = rules.filter("valid").withColumn("half", half.cast("int"))
    fitted = SV.fold_logit(fw.withColumn("graded", F.col("valid")), V.FEATURES, keys, min_rows=SCAN_LEARN)
    both_classes = (F.col("base") > 0) & (F.col("base") < 1)
    v = v.join(fitted.select(*keys, "pos", F.when(both_classes, F.round("p", 9)).alias("p")), [*keys, "pos"], "left")
    out = sizes.drop("_a")
    for x, name in (("score", "rules"), ("p", "ml")):
        whole = ST.rank_ic(v, keys, x, "y", f"{name}_ic").drop("n")
        halves = ST.rank_ic(v, [*keys, "half"], x, "y", "hic").groupBy(*keys).agg(F.when(F.count("hic") == 2, F.min("hic")).alias(f"{name}_stab"))
        out = out.join(whole, keys, "left").join(halves, keys, "left")
    out = out.withColumns({"combined": F.round(C.row_mean("rules_ic", "ml_ic"), 9), "stable": F.round(C.row_mean("rules_stab", "ml_stab"), 9)})
    # the best look-ahead by the stable score, where there is none by the combined one; of equal ones the first
    best = lambda c: F.max_by("horizon", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("horizon")))).over(Window.partitionBy("entity"))
    pick = F.coalesce(best("stable"), best("combined"), F.lit(6))
    return C.rounded(out.withColumn("chosen", pick))
