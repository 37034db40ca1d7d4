"""Analogue queries (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..operators import analogue as N
from ..sources import views as V
from . import common as P
from .registry import R, cte, query, sql

FE = V.FEATURES
SD = ", ".join(f"stddev_samp({f}) AS s_{f}" for f in FE)
DIST = "round(sqrt(" + "+".join(f"pow((a.{f}-b.{f})/CASE WHEN s_{f}>0 THEN s_{f} ELSE 1e0 END,2)" for f in FE) + "),12)"


def greedy_sql(ordered: str, k: int, gap: int) -> str:
    """Greedy pick over a list of {d,pos,y} sorted by (d,pos), as a fold."""
    return (f"list_reduce({ordered}, lambda acc, x: CASE WHEN len(acc)<{k} AND len(list_filter(acc, lambda c: abs(c.pos-x[1].pos)<{gap}))=0 "
            f"THEN list_concat(acc, x) ELSE acc END)")


cte("ana_d", f"""SELECT b.entity, b.pos, b.y, {DIST} AS d FROM fw b JOIN (SELECT entity, {SD} FROM fw WHERE y IS NOT NULL GROUP BY 1) s ON s.entity=b.entity
 JOIN (SELECT * FROM fw QUALIFY pos=max(pos) OVER (PARTITION BY entity)) a ON a.entity=b.entity WHERE b.y IS NOT NULL""", "fw")
cte("ana_l", f"SELECT entity, quantile_cont(d,0.5) AS md, {greedy_sql('list([{d: d, pos: pos, y: y}] ORDER BY d, pos)', 10, 3)} AS picks FROM ana_d GROUP BY 1", "ana_d")
cte("ana", "SELECT entity, md, p.pos AS pos, p.d AS d, p.y AS after, CAST(i AS INTEGER) AS place FROM (SELECT entity, md, unnest(picks) AS p, unnest(range(1,len(picks)+1)) AS i FROM ana_l)", "ana_l")


@query("analogues", sql("SELECT entity, place, CAST(pos AS INTEGER) AS pos, " + R("100e0*exp(-d/md) AS closeness", "after") + " FROM ana", "ana"))
def analogues(spark, sf):
    return C.rounded(N.analogues(P.feature_frame(spark, sf), FE, V.H))


@query("analogue_summary", sql("SELECT entity, count(*) AS n, " + R("quantile_cont(after,0.5) AS median", "avg(after) AS mean", "avg(CASE WHEN after>0 THEN 1e0 ELSE 0e0 END) AS positive", "min(after) AS worst", "max(after) AS best") + " FROM ana GROUP BY 1", "ana"))
def analogue_summary(spark, sf):
    a = F.col("after")
    g = N.analogues(P.feature_frame(spark, sf), FE, V.H).groupBy("entity")
    return C.rounded(
        g.agg(
            F.count(a).alias("n"), F.percentile(a, 0.5).alias("median"), F.avg(a).alias("mean"), F.avg((a > 0).cast("double")).alias("positive"),
            F.min(a).alias("worst"), F.max(a).alias("best"),
        )
    )


cte("emb", "SELECT vec_id, label, CAST(label AS DOUBLE)-4.5e0 AS y, embedding FROM embeddings")
cte("emb_d", """SELECT e.vec_id, e.label, e.y, round(sqrt(list_sum(list_transform(list_zip(e.embedding,q.embedding), lambda z: pow(CAST(z[1] AS DOUBLE)-CAST(z[2] AS DOUBLE),2)))),9) AS d
 FROM emb e, (SELECT * FROM emb ORDER BY vec_id DESC LIMIT 1) q WHERE e.vec_id<>q.vec_id""", "emb")


@query("greedy_gap_topk", sql(f"SELECT p.pos AS pos, round(p.d,6)+0e0 AS d, p.y AS y FROM (SELECT unnest({greedy_sql('list([{d: d, pos: vec_id, y: y}] ORDER BY d, vec_id)', 10, 5)}) AS p FROM emb_d)", "emb_d"))
def greedy_gap_topk(spark, sf, k: int = 10, gap: int = 5):
    """Nearest vectors to the latest one, at least `gap` positions apart."""
    e = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pos"), (F.col("label") - 4.5).cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("v")
    )
    now = e.agg(F.max_by(F.struct("pos", "v"), "pos")).scalar()  # one row, as a scalar subquery
    ones = F.transform("v", lambda _: F.lit(1.0))
    d = e.withColumn("q", now).filter(F.col("pos") != F.col("q.pos"))
    d = d.select(F.round(N.distance(F.col("v"), F.col("q.v"), ones), 9).alias("d"), "pos", "y")
    picked = N.nearest(d, [], k, gap).agg(F.array_sort(F.collect_list(F.struct("d", "pos", "y"))).alias("c"))
    picked = picked.select(F.explode(A.greedy_gap(F.col("c"), k, gap, "struct<d:double,pos:bigint,y:double>")).alias("p"))
    return C.rounded(picked.select("p.pos", "p.d", "p.y"))


cte("wa_s", "SELECT a.entity, a.pos AS t, a.month, count(*) AS n, " + ", ".join(f"stddev_samp(b.{f}) AS s_{f}" for f in FE)
    + " FROM fw a JOIN fw b ON a.entity=b.entity AND b.pos<=a.pos-3 AND b.y IS NOT NULL WHERE a.pos>=a.c1 GROUP BY ALL", "fw")
cte("wa_d", f"SELECT a.entity, a.pos AS t, a.month, b.pos, b.y, {DIST} AS d FROM fw a JOIN wa_s s ON s.entity=a.entity AND s.t=a.pos JOIN fw b ON b.entity=a.entity AND b.pos<=a.pos-3 AND b.y IS NOT NULL WHERE n>=36", "fw", "wa_s")
cte("wa_l", f"SELECT entity, month, {greedy_sql('list([{d: d, pos: pos, y: y}] ORDER BY d, pos)', 10, 3)} AS picks FROM wa_d GROUP BY 1,2", "wa_d")
cte("wa", "SELECT entity, month, list_aggregate(list_transform(picks, lambda p: p.y),'median') AS med, list_avg(list_transform(picks, lambda p: CASE WHEN p.y>0 THEN 1e0 ELSE 0e0 END)) AS pos FROM wa_l", "wa_l")


@query("wf_analogues", sql("SELECT entity, month, " + R("med", "pos AS share") + ", CASE WHEN med>0 AND pos>=0.6e0 THEN 'Favorable' WHEN med<=0 AND pos<=0.4e0 THEN 'Unfavorable' ELSE 'Neutral' END AS verdict FROM wa", "wa"))
def wf_analogues(spark, sf):
    a = N.walk_forward(P.feature_frame(spark, sf), FE, V.H)
    a = a.withColumn("verdict", N.verdict(F.col("med"), F.col("pos_share")))
    return C.rounded(a.select("entity", "month", "med", F.col("pos_share").alias("share"), "verdict"))


cte("paths", """SELECT a.entity, a.place, CAST(f.pos-a.pos AS INTEGER) AS step, (f.px/f0.px-1e0)*100e0 AS path FROM ana a JOIN fw f0 ON f0.entity=a.entity AND f0.pos=a.pos
 JOIN fw f ON f.entity=a.entity AND f.pos BETWEEN a.pos AND a.pos+3 WHERE a.pos+3<f0.n_all""", "ana", "fw")


@query("analogue_paths", sql("SELECT entity, place, step, round(path,6)+0e0 AS path, round(median(path) OVER (PARTITION BY entity, step),6)+0e0 AS median_path FROM paths", "paths"))
def analogue_paths(spark, sf):
    from pyspark.sql import Window

    fw = P.feature_frame(spark, sf)
    p = N.paths(N.analogues(fw, FE, V.H), fw, "px", V.H)
    return C.rounded(p.withColumn("median_path", F.percentile("path", 0.5).over(Window.partitionBy("entity", "step"))))
