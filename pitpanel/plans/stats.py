"""Statistics and resampling queries (group H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import factors as FA
from ..operators import stats as ST
from ..operators import states as S
from ..operators import targets as T
from ..sources import views as V
from . import common as P
from .registry import R, cte, erfc_sql, query, sql


def hac_ctes(p: str, src: str, keys: str, y: str, d: str, h: int) -> str:
    """HAC t of y on d per key, from a source with `pos`."""
    lagc = ", ".join(f"lag(u,{k}) OVER w AS u{k}" for k in range(1, h + 1))
    lags = ", ".join(f"sum(u*u{k}) AS s{k}" for k in range(1, h + 1))
    var = " + ".join(["s0"] + [f"2e0*(1e0-{k}/{h + 1}e0)*coalesce(s{k},0)" for k in range(1, h + 1)])
    cte(f"{p}_m", f"""SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, sum({y}) AS sy, sum({d}) AS sd, sum({d}*{y}) AS sdy,
 count(*)*sum({d}*{d})-sum({d})*sum({d}) AS dd FROM {src} GROUP BY {keys}""", src)
    cte(f"{p}_b", f"SELECT *, CASE WHEN dd>0 THEN (n*sdy-sd*sy)/dd ELSE (sd/n)*(sy/n)/(1e0+(sd/n)*(sd/n)) END AS b FROM {p}_m", f"{p}_m")
    cte(f"{p}_u", f"""SELECT {keys}, pos, b, ({y}-(sy-b*sd)/n-b*{d})*(CASE WHEN dd>0 THEN (n*{d}-sd)/dd ELSE (sd/n)/(n*(1e0+(sd/n)*(sd/n))) END) AS u
 FROM {src} JOIN {p}_b USING ({keys})""", src, f"{p}_b")
    cte(f"{p}_t", f"""SELECT {keys}, CASE WHEN var>0 THEN b/sqrt(var) ELSE 0e0 END AS t FROM (SELECT {keys}, b, {var} AS var FROM (
 SELECT {keys}, any_value(b) AS b, sum(u*u) AS s0, {lags} FROM (SELECT *, {lagc} FROM {p}_u WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) GROUP BY {keys}))""", f"{p}_u")
    return f"{p}_t"


def ranks_sql(src: str, keys: str, x: str, y: str, where: str = "true") -> str:
    """Average ranks rx, ry over complete pairs."""
    return f"""SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x})-1)/2e0 AS rx,
 rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y})-1)/2e0 AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND ({where})"""


CORR = "(count(*)*sum(rx*ry)-sum(rx)*sum(ry))/nullif(sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))),0)"


def ic_cte(name: str, src: str, keys: str, x: str = "x", y: str = "y", where: str = "true", min_n: int = 8) -> str:
    cte(f"{name}_r", ranks_sql(src, keys, x, y, where), src)
    return cte(name, f"SELECT {keys}, count(*) AS n, CASE WHEN count(*)>={min_n} THEN {CORR} END AS ic FROM {name}_r GROUP BY {keys}", f"{name}_r")


cte("learn", "SELECT * FROM fl WHERE part='learn'", "fl")
cte("learn_rank", ranks_sql("learn", "entity, feature", "x", "y"), "learn")
hac_ctes("hr", "learn_rank", "entity, feature", "ry", "rx", 3)
hac_ctes("hx", "learn", "entity, feature", "y", "x", 5)


@query("hac_t", sql("SELECT entity, feature, round(hx_t.t,6)+0e0 AS t, round(hr_t.t,6)+0e0 AS t_rank FROM hx_t JOIN hr_t USING (entity, feature)", "hx_t", "hr_t"))
def hac_t(spark, sf):
    k = ["entity", "feature"]
    fl = P.feature_long(spark, sf).filter(F.col("part") == "learn")
    raw = ST.hac_t(fl, k, "y", "x", 5)
    ranked = fl.withColumns({"rx": C.avg_rank("x", *k), "ry": C.avg_rank("y", *k)})
    return C.rounded(raw.join(ST.hac_t(ranked, k, "ry", "rx", 3).withColumnRenamed("t", "t_rank"), k))


cte("bhp", f"SELECT entity, feature, {erfc_sql('abs(t)/sqrt(2e0)')} AS p FROM hx_t", "hx_t")
cte("bhr", "SELECT *, p*count(*) OVER (PARTITION BY entity)/row_number() OVER (PARTITION BY entity ORDER BY p, feature) AS r FROM bhp", "bhp")


@query("bh_q", sql("SELECT entity, feature, round(p,6)+0e0 AS p, round(least((SELECT min(b.r) FROM bhr b WHERE b.entity=a.entity AND b.p>=a.p),1e0),6)+0e0 AS q FROM bhr a", "bhr"))
def bh_q(spark, sf):
    fl = P.feature_long(spark, sf).filter(F.col("part") == "learn")
    t = ST.hac_t(fl, ["entity", "feature"], "y", "x", 5).withColumn("p", C.two_sided_p("t"))
    return C.rounded(ST.bh_q(t, ["entity"], "p", ("feature",)).select("entity", "feature", "p", "q"))


ic_cte("ic_part", "fl", "entity, feature, part", where="part IN ('learn','val','test')")


@query("rank_ic", sql("SELECT entity, feature, part, n, " + R("ic") + " FROM ic_part", "ic_part"))
def rank_ic(spark, sf):
    fl = P.feature_long(spark, sf).filter(F.col("part").isin("learn", "val", "test"))
    return C.rounded(ST.rank_ic(fl, ["entity", "feature", "part"], "x", "y"))


cte("roll_pairs", """SELECT a.entity, a.feature, a.month, a.pos AS e, b.x, b.y FROM fl a JOIN fl b ON a.entity=b.entity AND a.feature=b.feature AND b.pos BETWEEN a.pos-59 AND a.pos
 WHERE a.y IS NOT NULL AND b.y IS NOT NULL""", "fl")
cte("roll_r", ranks_sql("roll_pairs", "entity, feature, e", "x", "y"), "roll_pairs")


@query("rolling_ic", sql(f"SELECT entity, feature, any_value(month) AS month, CASE WHEN count(*)=60 THEN round({CORR},6)+0e0 END AS ic FROM roll_r GROUP BY entity, feature, e", "roll_r"))
def rolling_ic(spark, sf):
    out = ST.rolling_rank_ic(P.feature_long(spark, sf), ["entity", "feature"], "x", "y", 60)
    return C.rounded(out.select("entity", "feature", "month", "ic"))


cte("fr", "SELECT *, rank() OVER (PARTITION BY entity, feature ORDER BY x) + (count(*) OVER (PARTITION BY entity, feature, x)-1)/2e0 AS rk FROM fl", "fl")
cte("sp", """SELECT entity, fa AS feature_a, fb AS feature_b, (count(*)*sum(rx*ry)-sum(rx)*sum(ry))/sqrt((count(*)*sum(rx*rx)-sum(rx)*sum(rx))*(count(*)*sum(ry*ry)-sum(ry)*sum(ry))) AS rho FROM (
 SELECT a.entity, a.feature AS fa, b.feature AS fb, a.rk AS rx, b.rk AS ry FROM fr a JOIN fr b ON a.entity=b.entity AND a.pos=b.pos) GROUP BY ALL""", "fr")
ORD = "list_position(['disc','tax','ret_d3','qty_c3','px_m6','px_t10'], {})"
UP = f"{ORD.format('feature_a')} < {ORD.format('feature_b')}"


@query("spearman_pairs", sql(f"SELECT entity, feature_a, feature_b, round(rho,6)+0e0 AS rho FROM sp WHERE {UP}", "sp"))
def spearman_pairs(spark, sf):
    return C.rounded(ST.spearman_pairs(P.feature_frame(spark, sf), V.FEATURES))


@query("redundant_pairs", sql(f"SELECT entity, feature_a, feature_b, round(rho,6)+0e0 AS rho, rank() OVER (PARTITION BY entity ORDER BY round(abs(rho),9) DESC, feature_a, feature_b) AS place FROM sp WHERE {UP} AND abs(rho)>=0.3", "sp"))
def redundant_pairs(spark, sf, thr: float = 0.3):
    p = ST.spearman_pairs(P.feature_frame(spark, sf), V.FEATURES).filter(F.abs("rho") >= thr)
    w = Window.partitionBy("entity").orderBy(F.desc(F.round(F.abs("rho"), 9)), "feature_a", "feature_b")
    return C.rounded(p.withColumn("place", F.rank().over(w).cast("bigint")))


# --------------------------------------------------------------------------- bootstrap
LCG = 2147483647


def start_sql(m: str, rep: str, blk: str, seed: int = 0) -> str:
    z = f"(({rep}*1000003+{blk}*7919+{seed * 104729 + 12345})%{LCG})"
    z2 = f"((({z})*({z})+{rep}*31+{blk})%{LCG})"
    return f"(((({z2})*({z2})+48271*{blk}+7)%{LCG})%({m}))"


cte("evy", "SELECT DISTINCT entity, pos, month, y, part FROM fl WHERE y IS NOT NULL", "fl")
cte("evn", "SELECT entity, count(*) AS n FROM evy GROUP BY 1", "evy")
cte("boot", f"""SELECT entity, rep, i*3+o AS draw, {start_sql('n-3+1', 'rep', 'i')}+o AS pos FROM (
 SELECT entity, CAST(n AS BIGINT) AS n, CAST(rep AS BIGINT) AS rep, CAST(i AS BIGINT) AS i, o FROM evn, range(1000) r(rep), range(100) b(i), range(3) q(o) WHERE i < ceil(n/3e0)) WHERE i*3+o<n""", "evn")


@query("block_bootstrap", sql("SELECT entity, CAST(rep AS INTEGER) AS rep, count(*) AS draws, CAST(sum(pos) AS BIGINT) AS total, CAST(sum(pos*(draw+1)) AS BIGINT) AS weighted, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM boot GROUP BY 1,2", "boot"))
def block_bootstrap(spark, sf, reps: int = 1000, block: int = 3):
    """What 1000 moving-block resamples of every entity draw: number, sums (plain and by place) and range of positions."""
    g = P.feature_frame(spark, sf).filter(F.col("y").isNotNull()).groupBy("entity").agg(F.count(F.lit(1)).cast("int").alias("n"))
    d = ST.block_positions(g, "n", block, reps, ["entity"])
    pos = F.col("pos").cast("bigint")
    return d.groupBy("entity", "rep").agg(F.count(F.lit(1)).alias("draws"), F.sum(pos).alias("total"), F.sum(pos * (F.col("draw") + 1)).alias("weighted"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def ci_ctes(p: str, src: str, keys: str, block: int, reps: int) -> str:
    """Bootstrap interval of the mean of y by explicit resampling."""
    cte(f"{p}_v", f"SELECT {keys}, y, row_number() OVER (PARTITION BY {keys} ORDER BY pos)-1 AS i FROM {src} WHERE y IS NOT NULL", src)
    cte(f"{p}_n", f"SELECT {keys}, count(*) AS n, CAST(greatest(1,least({block},count(*))) AS BIGINT) AS b FROM {p}_v GROUP BY {keys}", f"{p}_v")
    cte(f"{p}_d", f"""SELECT {keys}, rep, {start_sql('n-b+1', 'rep', 'k')}+o AS i FROM (
 SELECT {keys}, n, b, CAST(rep AS BIGINT) AS rep, CAST(k AS BIGINT) AS k, CAST(o AS BIGINT) AS o FROM {p}_n, range({reps}) r(rep), range(200) q(k), range({block}) z(o)
 WHERE k<ceil(n/CAST(b AS DOUBLE)) AND o<b AND k*b+o<n)""", f"{p}_n")
    cte(f"{p}_mean", f"SELECT {keys}, rep, avg(y) AS m FROM {p}_d JOIN {p}_v USING ({keys}, i) GROUP BY {keys}, rep", f"{p}_d", f"{p}_v")
    return cte(f"{p}_ci", f"""SELECT {keys}, n, CASE WHEN n>=5 THEN quantile_cont(m,0.025) END AS lo, CASE WHEN n>=5 THEN quantile_cont(m,0.975) END AS hi
 FROM {p}_mean JOIN {p}_n USING ({keys}) GROUP BY {keys}, n""", f"{p}_mean", f"{p}_n")


cte("vd_known", "SELECT entity, verdict, pos, y FROM a_vd WHERE y IS NOT NULL", "a_vd")
ci_ctes("bc", "vd_known", "entity, verdict", 3, 1000)


@query("block_ci", sql("SELECT entity, verdict, n, " + R("lo", "hi") + " FROM bc_ci", "bc_ci"))
def block_ci(spark, sf):
    return C.rounded(ST.block_ci(P.learned(spark, sf)[3], ["entity", "verdict"], "y", 3, 1000))


cte("vd_all", "SELECT entity, verdict AS g, pos, y FROM a_vd WHERE y IS NOT NULL UNION ALL SELECT entity, 'All months', pos, y FROM a_vd WHERE y IS NOT NULL", "a_vd")
ci_ctes("sm", "vd_all", "entity, g", 3, 1000)
cte("sm_s", """SELECT entity, g, count(*) AS months, avg(y) AS avg, quantile_cont(y,0.5) AS median, avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) AS win, min(y) AS worst, max(y) AS best,
 quantile_cont(dd,0.5) AS dd FROM vd_all JOIN dd6 USING (entity,pos) GROUP BY ALL""", "vd_all", "dd6")
cte("sm_g", "SELECT entity, v.g FROM (SELECT DISTINCT entity FROM a_vd), (VALUES ('Favorable'),('Neutral'),('Unfavorable'),('All months')) v(g)", "a_vd")


@query("summarize", sql("SELECT x.entity, x.g AS verdict, coalesce(months,0) AS months, " + R("avg", "median", "win", "worst", "best", "dd", "lo", "hi")
    + " FROM sm_g x LEFT JOIN sm_s USING (entity,g) LEFT JOIN sm_ci USING (entity,g)", "sm_g", "sm_s", "sm_ci"))
def summarize(spark, sf):
    """Outcome by verdict in fixed order plus all months, with bootstrap intervals; empty groups appear."""
    _, _, _, sc = P.learned(spark, sf)
    dd = T.forward_drawdown("px", V.H, C.by_entity("entity"))
    px = P.feature_frame(spark, sf).withColumn("dd", dd).select("entity", "pos", "dd")
    rows = sc.join(px, ["entity", "pos"]).filter(F.col("y").isNotNull())
    summary = ST.outcome_summary(rows, ["entity"], "verdict", "y", "dd")
    groups = F.array(*[F.lit(g) for g in (S.FAV, S.NEU, S.UNF, "All months")])
    copies = rows.withColumn("verdict", F.explode(F.array(F.col("verdict"), F.lit("All months"))))
    ci = ST.block_ci(copies, ["entity", "verdict"], "y", V.H, 1000).drop("n")
    every = sc.groupBy("entity").agg(F.lit(1).alias("_")).select("entity", F.explode(groups).alias("verdict"))
    on = ["entity", "verdict"]
    return C.rounded(every.join(summary, on, "left").join(ci, on, "left").fillna(0, ["months"]))


# --------------------------------------------------------------------------- factors
@query("factor_merge")
def factor_merge(spark, sf):
    """Factor table (feature, factor, sign) from the correlation structure of the learn rows."""
    fw = P.feature_frame(spark, sf).filter(F.col("part") == "learn")
    return FA.factor_table(ST.spearman_pairs(fw, V.FEATURES), V.FEATURES, 0.25)


@query("factor_scores")
def factor_scores(spark, sf):
    fw = P.feature_frame(spark, sf)
    table = FA.factor_table(ST.spearman_pairs(fw.filter(F.col("part") == "learn"), V.FEATURES), V.FEATURES, 0.25)
    fl = T.long_form(fw, V.FEATURES, ("entity", "month", "pos", "part"))
    return C.rounded(FA.factor_scores(fl, table, F.col("part") == "learn").select("entity", "month", "factor", "x"))


@query("factor_jaccard")
def factor_jaccard(spark, sf):
    fw = P.feature_frame(spark, sf).filter(F.col("part") == "learn")
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    half = fw.withColumn("half", (F.col("pos") >= F.floor(n / 2)).cast("int"))
    pairs = ST.spearman_pairs(half, V.FEATURES, ("entity", "half"))
    table = FA.factor_table(pairs, V.FEATURES, 0.25, keys=("entity", "half"))
    return C.rounded(FA.merged_pair_overlap(table))
