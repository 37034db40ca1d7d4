"""Regime and persistence queries (group L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import regime as G
from . import common as P
from .rank import PILLAR
from .registry import R, cte, query, sql
from .rules import latest

GROWTH, INFL = (("qty_c3", 1), ("px_t10", 1)), (("disc", 1), ("tax", -1), ("ret_d3", 1))


def _z(c, s):
    return f"({s}*({c}-avg({c}) FILTER (part='learn') OVER (PARTITION BY entity))/stddev_samp({c}) FILTER (part='learn') OVER (PARTITION BY entity))"


cte("reg0", "SELECT entity, month, pos, part, y, (" + "+".join(_z(c, s) for c, s in GROWTH) + f")/{len(GROWTH)}e0 AS g, (" + "+".join(_z(c, s) for c, s in INFL) + f")/{len(INFL)}e0 AS i FROM fw", "fw")
cte("reg", f"""SELECT *, CASE WHEN g>0 THEN CASE WHEN i>0 THEN '{G.REGIMES[1]}' ELSE '{G.REGIMES[0]}' END ELSE CASE WHEN i>0 THEN '{G.REGIMES[2]}' ELSE '{G.REGIMES[3]}' END END AS regime FROM reg0""", "reg0")


def regimes(spark, sf):
    learn = F.col("part") == "learn"
    fw = P.feature_frame(spark, sf)
    fw = fw.withColumns({"g": G.signed_z(GROWTH, learn), "i": G.signed_z(INFL, learn)})
    return fw.withColumn("regime", G.classify(F.col("g"), F.col("i")))


@query("regime", sql("SELECT entity, month, " + R("g", "i") + ", regime FROM reg", "reg"))
def regime(spark, sf):
    return C.rounded(regimes(spark, sf).select("entity", "month", "g", "i", "regime"))


@query("regime_outcomes", sql("SELECT entity, regime, count(y) AS months, " + R("avg(y) AS avg", "quantile_cont(y,0.5) AS median", "min(y) AS worst", "max(y) AS best") + " FROM reg WHERE part<>'test' GROUP BY 1,2", "reg"))
def regime_outcomes(spark, sf):
    r = regimes(spark, sf).filter(F.col("part") != "test")
    return C.rounded(
        r.groupBy("entity", "regime").agg(
            F.count("y").alias("months"), F.avg("y").alias("avg"), F.percentile("y", 0.5).alias("median"), F.min("y").alias("worst"), F.max("y").alias("best")
        )
    )


cte("trn", "SELECT *, CASE WHEN b<>a THEN b||' → '||a END AS tr FROM (SELECT *, split_part(regime,' (',1) AS a, lag(split_part(regime,' (',1),3) OVER (PARTITION BY entity ORDER BY pos) AS b FROM reg)", "reg")


@query("regime_transitions", sql("SELECT entity, tr AS transition, count(y) AS months, " + R("avg(y) AS avg", "quantile_cont(y,0.5) AS median", "avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) AS win")
    + ", tr = (SELECT t2.tr FROM trn t2 WHERE t2.entity=trn.entity AND t2.pos=(SELECT max(t3.pos) FROM trn t3 WHERE t3.entity=trn.entity)) AS current FROM trn WHERE tr IS NOT NULL AND y IS NOT NULL GROUP BY 1,2 HAVING count(y)>=6", "trn"))
def regime_transitions(spark, sf):
    t = G.transitions(regimes(spark, sf), "regime", C.by_entity("entity"))
    now = F.max_by(F.struct("transition"), "pos").over(Window.partitionBy("entity"))
    t = t.withColumn("_now", now).filter(F.col("transition").isNotNull() & F.col("y").isNotNull())
    g = t.groupBy("entity", "transition").agg(
        F.count("y").alias("months"),
        F.avg("y").alias("avg"),
        F.percentile("y", 0.5).alias("median"),
        F.avg((F.col("y") > 0).cast("double")).alias("win"),
        (F.col("transition") == F.first("_now.transition")).alias("current"),
    )
    return C.rounded(g.filter(F.col("months") >= 6))


cte("str0", "SELECT *, sum(CASE WHEN prev IS NULL OR prev<>verdict THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY pos) AS run FROM (SELECT *, lag(verdict) OVER (PARTITION BY entity ORDER BY pos) AS prev FROM a_vd)", "a_vd")
cte("str1", "SELECT *, row_number() OVER (PARTITION BY entity, run ORDER BY pos) AS rl, count(*) OVER (PARTITION BY entity, run) AS rn FROM str0", "str0")
cte("str2", "SELECT entity, arg_max(verdict,pos) AS cur, arg_max(rl,pos) AS streak FROM str1 GROUP BY 1", "str1")


@query("streaks", sql("""SELECT s.entity, any_value(cur) AS current, CAST(any_value(streak) AS INTEGER) AS streak, round(quantile_cont(rn,0.5) FILTER (verdict=cur AND rl=1),6)+0e0 AS typical_run,
 count(y) FILTER (verdict=cur AND rl>=3 AND part<>'test') AS n_after, round(avg(y) FILTER (verdict=cur AND rl>=3 AND part<>'test'),6)+0e0 AS avg_after FROM str1 s JOIN str2 USING (entity) GROUP BY 1""", "str1", "str2"))
def streaks(spark, sf):
    sc = P.learned(spark, sf)[3]
    return C.rounded(G.streak_summary(sc, "verdict", "y", F.col("part") != "test"))


cte("pil", """SELECT entity, pillar, count(*) AS n, 100e0*(count(*) FILTER (weight>0)-count(*) FILTER (weight<0))/count(*) AS score FROM last_state JOIN meta USING (feature)
 LEFT JOIN (SELECT entity, feature, state, weight FROM a_rl) USING (entity, feature, state) GROUP BY 1,2""", "last_state", "a_rl", "meta")


@query("pillar_scores", sql("SELECT entity, pillar, n, " + R("score", "avg(score) FILTER (pillar<>'trend') OVER (PARTITION BY entity) AS backdrop") + ", CASE WHEN score>15 THEN 'up' WHEN score<-15 THEN 'down' ELSE 'flat' END AS label FROM pil", "pil"))
def pillar_scores(spark, sf):
    st, _, rules, _ = P.learned(spark, sf)
    now = latest(st, ["entity", "feature"], ["state"])
    pillar = F.create_map(*[F.lit(x) for kv in PILLAR.items() for x in kv])[F.col("feature")]
    on = ["entity", "feature", "state"]
    j = now.join(rules.select(*on, "weight"), on, "left").withColumn("pillar", pillar)
    net = F.count(F.when(F.col("weight") > 0, 1)) - F.count(F.when(F.col("weight") < 0, 1))
    g = j.groupBy("entity", "pillar").agg(F.count(F.lit(1)).alias("n"), (100.0 * net / F.count(F.lit(1))).alias("score"))
    other = F.avg(F.when(F.col("pillar") != "trend", F.col("score"))).over(Window.partitionBy("entity"))
    label = F.when(F.col("score") > 15, "up").when(F.col("score") < -15, "down").otherwise("flat")
    return C.rounded(g.withColumns({"backdrop": other, "label": label}))
