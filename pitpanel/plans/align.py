"""Time-alignment queries (group B)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as AL
from ..operators import features as FE
from ..operators import targets as T
from ..sources import landed as L
from ..sources import views as V
from . import common as P
from .registry import R, cte, query, sql

# publication lag (months, days) per series; '(1, 15)' = a month and 15 days
LAGS = {"1-URGENT": (0, 1), "2-HIGH": (1, 15), "3-MEDIUM": (1, 0), "4-NOT SPECIFIED": (3, 0), "5-LOW": (2, 10)}
cte("lagdim", "SELECT * FROM (VALUES " + ",".join(f"('{k}',{m},{d})" for k, (m, d) in LAGS.items()) + ") t(series_id,mo,dd)")
cte("lagged", "SELECT d.*, CAST(obs_date + to_months(mo) AS DATE) + dd AS rule_date FROM daily_obs d JOIN lagdim USING (series_id)", "daily_obs", "lagdim")


def rule_date(obs: str = "obs_date"):
    mo = F.create_map(*[F.lit(x) for k, (m, _) in LAGS.items() for x in (k, m)])
    dd = F.create_map(*[F.lit(x) for k, (_, d) in LAGS.items() for x in (k, d)])
    # a series without an entry is taken as published on its own date
    return AL.lagged(F.col(obs), *[F.coalesce(m[F.col("series_id")], F.lit(0)) for m in (mo, dd)])


@query("publication_lag", sql("SELECT series_id, obs_date, rule_date FROM lagged", "lagged"))
def publication_lag(spark, sf):
    return V.daily_obs(spark, sf).select("series_id", "obs_date", rule_date().alias("rule_date"))


cte("sane", """SELECT f.series_id, f.obs_date, f.value, CASE WHEN release_date BETWEEN f.obs_date AND f.obs_date+150 THEN release_date ELSE CAST(f.obs_date + to_months(mo) AS DATE) + dd END AS avail_date
 FROM first_rel f JOIN lagdim USING (series_id)""", "first_rel", "lagdim")


@query("sane_release", sql("SELECT series_id, obs_date, avail_date, round(value,6)+0e0 AS value FROM sane", "sane"))
def sane_release(spark, sf):
    f = L.first_release(V.vintages(spark, sf))
    avail = AL.sane_release(F.col("obs_date"), F.col("release_date"), rule_date())
    return C.rounded(f.select("series_id", "obs_date", avail.alias("avail_date"), "value"))


@query("avail_dedupe", sql("""SELECT series_id, avail_date, obs_date, round(value,6)+0e0 AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY series_id, avail_date ORDER BY obs_date DESC) AS rn FROM sane) WHERE rn=1""", "sane"))
def avail_dedupe(spark, sf):
    f = L.first_release(V.vintages(spark, sf))
    avail = AL.sane_release(F.col("obs_date"), F.col("release_date"), rule_date())
    return C.rounded(AL.available(f, ["series_id"], "obs_date", avail, "value"))


SERIES = tuple(LAGS)
NAMES = ("s1", "s2", "s3", "s4", "s5")
cte("avail_one", "SELECT series_id, d, value FROM (SELECT series_id, rule_date AS d, value, row_number() OVER (PARTITION BY series_id, rule_date ORDER BY obs_date DESC) AS rn FROM lagged) WHERE rn=1", "lagged")
cte("wide_days", "SELECT d, " + ", ".join(f"max(value) FILTER (series_id='{k}') AS {n}" for k, n in zip(SERIES, NAMES)) + " FROM avail_one GROUP BY d", "avail_one")
cte("ffilled", "SELECT d, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n in NAMES) + " FROM wide_days", "wide_days")


def wide_daily(spark, sf):
    """Availability-dated series on one axis, filled by blocks of days."""
    one = AL.available(V.daily_obs(spark, sf), ["series_id"], "obs_date", rule_date(), "value")
    out = AL.outer_ffill(one.withColumnRenamed("avail_date", "d"), SERIES)
    return out.select("d", *[F.col(f"`{s}`").alias(n) for s, n in zip(SERIES, NAMES)])


@query("outer_ffill", sql("SELECT d, " + R(*NAMES) + " FROM ffilled", "ffilled"))
def outer_ffill(spark, sf):
    return C.rounded(wide_daily(spark, sf))


@query("month_end_last", sql("""SELECT last_day(m) AS month, """ + R(*NAMES) + """ FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE) AS m FROM ffilled)
 LEFT JOIN LATERAL (SELECT """ + ", ".join(f"{n}" for n in NAMES) + " FROM ffilled f WHERE f.d<=last_day(m) ORDER BY f.d DESC LIMIT 1) ON true", "ffilled"))
def month_end_last(spark, sf):
    """One row per month after the daily reduction; only those rows share the axis of the one market."""
    m = AL.month_end_last(wide_daily(spark, sf), [], "d", NAMES).withColumn("market", F.lit("all"))
    return C.rounded(V.dense_months(m, "market").select("month", *NAMES))


@query("truncate_after", sql("SELECT series_id, d, round(value,6)+0e0 AS value FROM avail_one WHERE d <= (SELECT max(obs_date) FROM daily_obs WHERE series_id='1-URGENT')", "avail_one", "daily_obs"))
def truncate_after(spark, sf):
    """Availability dates after the last price are not known yet."""
    obs = V.daily_obs(spark, sf)
    one = AL.available(obs, ["series_id"], "obs_date", rule_date(), "value")
    last = obs.filter(F.col("series_id") == "1-URGENT").agg(F.max("obs_date")).scalar()
    return C.rounded(one.filter(F.col("avail_date") <= last).select("series_id", F.col("avail_date").alias("d"), "value"))


cte("two", """SELECT CAST(o_custkey%5 AS INTEGER) AS entity, CAST(o_orderdate AS DATE) AS d,
 (CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0)/CAST(count(*) AS DOUBLE) AS c1,
 (CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) FILTER (o_orderstatus<>'F') AS DOUBLE)/100e0)/CAST(count(*) FILTER (o_orderstatus<>'F') AS DOUBLE) AS c2
 FROM orders GROUP BY 1,2""")


def two_contracts(spark, sf):
    """Daily front and second contract per entity; the second is missing on some days."""
    c, later = V.cents("o_totalprice"), F.col("o_orderstatus") != "F"
    g = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).cast("int").alias("entity"), F.to_date("o_orderdate").alias("d"))
    return g.agg(
        ((F.sum(c) / 100.0) / F.count(F.lit(1)).cast("double")).alias("c1"),
        F.try_divide(F.sum(F.when(later, c)) / 100.0, F.count(F.when(later, 1)).cast("double")).alias("c2"),
    )


cte("spl", """SELECT *, max(CASE WHEN spot IS NOT NULL THEN d END) OVER (PARTITION BY entity) AS last_d,
 last_value(spot IGNORE NULLS) OVER w AS sf, last_value(fut IGNORE NULLS) OVER w AS ff FROM (SELECT entity, d, c2 AS fut, CASE WHEN d < DATE '2000-06-01' - entity*30 THEN c1 END AS spot FROM two)
 WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "two")


@query("splice_price", sql("""SELECT s.entity, d, """ + R("CASE WHEN d<=last_d THEN sf ELSE s.ff*(k.spot/k.ff) END AS price", digits=5) + """
 FROM spl s JOIN (SELECT entity, spot, ff FROM spl WHERE d=last_d) k USING (entity)""", "spl"))
def splice_price(spark, sf):
    t = two_contracts(spark, sf)
    cut = F.date_sub(F.to_date(F.lit("2000-06-01")), F.col("entity") * 30)
    t = t.select("entity", "d", F.col("c2").alias("fut"), F.when(F.col("d") < cut, F.col("c1")).alias("spot"))
    return C.rounded(AL.splice(t, ["entity"], "d", "spot", "fut", "price").select("entity", "d", "price"), 5)


@query("drop_without_target", sql("SELECT entity, d, " + R("c1", "c2 AS target") + " FROM two WHERE c2 IS NOT NULL AND c2>0", "two"))
def drop_without_target(spark, sf):
    """Rows whose target is missing or not positive are of no use to any fit."""
    return C.rounded(AL.with_target(two_contracts(spark, sf).withColumnRenamed("c2", "target"), "target").select("entity", "d", "c1", "target"))


@query("start_slice", sql("""SELECT entity, min(month) AS first, max(month) AS last, count(*) AS n FROM feat_all f
 WHERE month >= (SELECT min(month) FROM feat_all g WHERE g.entity=f.entity AND g.px_t10 IS NOT NULL) AND month >= DATE '1990-01-01' GROUP BY entity""", "feat_all"))
def start_slice(spark, sf):
    first = F.min(F.when(F.col("px_t10").isNotNull(), F.col("month"))).over(Window.partitionBy("entity"))
    f = P.features_all(spark, sf).withColumn("_first", first)
    f = f.filter((F.col("month") >= F.col("_first")) & (F.col("month") >= F.lit("1990-01-01").cast("date")))
    return f.groupBy("entity").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("n"))


@query("complete_case", sql("SELECT entity, month, pos, " + R("disc", "tax", "ret_d3", "qty_c3", "px_m6", "px_t10", digits=8) + " FROM fw", "fw"))
def complete_case(spark, sf):
    full = T.complete_case(P.features_all(spark, sf), V.FEATURES)
    return C.rounded(full.select("entity", "month", "pos", *V.FEATURES), 8)


cte("covl", " UNION ALL ".join(f"SELECT entity, month, '{c}' AS feature, {c} AS x FROM feat_all" for c in (*V.FEATURES, "y")) + " UNION ALL SELECT entity, month, 'gone', NULL FROM feat_all", "feat_all")


@query("coverage", sql("""SELECT entity, feature, n, first, last, CASE WHEN n=0 THEN 'dropped' WHEN first <= last_day(CAST(start + INTERVAL 4 YEAR AS DATE)) THEN 'default on' ELSE 'optional' END AS status FROM (
 SELECT entity, feature, count(x) AS n, min(month) FILTER (x IS NOT NULL) AS first, max(month) FILTER (x IS NOT NULL) AS last, min(month) AS start FROM covl GROUP BY ALL)""", "covl"))
def coverage(spark, sf):
    f = P.features_all(spark, sf).withColumn("gone", F.lit(None).cast("double"))
    long = T.long_form(f, (*V.FEATURES, "y", "gone"), ("entity", "month"))
    start = F.min("month").over(Window.partitionBy("entity", "feature"))
    cov = AL.coverage(long.withColumn("start", start), ("entity", "feature", "start"))
    late = F.last_day(F.add_months("start", 48))
    status = F.when(F.col("n") == 0, "dropped").when(F.col("first") <= late, "default on").otherwise("optional")
    return cov.withColumn("status", status).drop("start")


@query("asof_lookup", sql("""SELECT f.entity, f.month, """ + R("f.px AS px", "g.px AS px_ref", "f.qty AS qty", "g.qty AS qty_ref", digits=5) + """ FROM (SELECT *, max(month) OVER (PARTITION BY entity) AS top FROM panel) f
 ASOF JOIN panel g ON f.entity=g.entity AND last_day(CAST(f.top - INTERVAL 3 MONTH AS DATE)) >= g.month WHERE f.month=f.top""", "panel"))
def asof_lookup(spark, sf):
    return C.rounded(AL.asof_value(V.monthly_panel(spark, sf), ["entity"], "month", ["px", "qty"], 3), 5)


EVENTS = ["1995-11-28", "1997-07-09", "1999-05-11", "2001-02-20"]


@query("months_since_event", sql("SELECT d, count(*) AS n, " + R("date_diff('day', (SELECT max(e) FROM (VALUES "
    + ",".join(f"(DATE '{e}')" for e in EVENTS) + ") v(e) WHERE e<=d), d)/30.4375e0 AS age") + " FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY d"))
def months_since_event(spark, sf):
    o = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return C.rounded(o.withColumn("age", AL.months_since_event(F.col("d"), EVENTS)))


cte("rollx", """SELECT t.*, lag(d) OVER w AS pd, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2, last_day(d) AS mo FROM two t WINDOW w AS (PARTITION BY entity ORDER BY d)""", "two")
cte("expi", "SELECT (SELECT e.d FROM bdays e WHERE e.bdn=(SELECT c.bdn FROM cal c WHERE c.d=m+24)-3) AS e FROM (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS m FROM two)", "cal", "bdays", "two")
cte("rolly", """SELECT *, sum(pnl) OVER (PARTITION BY entity, mo ORDER BY d) AS mtd FROM (SELECT *, coalesce(c1 - CASE WHEN EXISTS (SELECT 1 FROM expi WHERE e>=pd AND e<d) THEN coalesce(p2,p1) ELSE p1 END,0e0) AS pnl FROM rollx)""", "rollx", "expi")
cte("rollm", """SELECT entity, mo, lag(px) OVER (PARTITION BY entity ORDER BY mo) AS base, lmtd FROM (SELECT entity, mo, arg_max(c1,d) AS px, arg_max(mtd,d) AS lmtd FROM rolly GROUP BY 1,2)""", "rolly")
cte("rolll", """SELECT *, coalesce(lag(cum) OVER (PARTITION BY entity ORDER BY mo),1e0) AS lvl FROM (SELECT *, product(1e0+CASE WHEN base>0 THEN lmtd/base ELSE 0e0 END) OVER (PARTITION BY entity ORDER BY mo) AS cum FROM rollm)""", "rollm")


@query("roll_index", sql("SELECT entity, d, " + R("100e0*lvl*(1e0+mtd/base) AS idx", digits=4) + " FROM rolly JOIN rolll USING (entity, mo) WHERE base>0", "rolly", "rolll"))
def roll_index(spark, sf):
    r = FE.roll_index(two_contracts(spark, sf), ["entity"], "d", "c1", "c2")
    return C.rounded(r.select("entity", "d", F.col("index").alias("idx")), 4)


cte("rv0", "SELECT *, dayofweek(d) BETWEEN 1 AND 5 AND c1>5 AS op FROM two", "two")
cte("rv1", """SELECT entity, d, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w END*sqrt(252e0)*100e0 AS v FROM (
 SELECT *, c1/lag(c1) OVER (PARTITION BY entity ORDER BY d)-1e0 AS r FROM rv0 WHERE op) WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""", "rv0")


@query("realised_vol", sql("""SELECT entity, d, round(last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),5)+0e0 AS rv
 FROM rv0 LEFT JOIN rv1 USING (entity, d)""", "rv0", "rv1"))
def realised_vol(spark, sf):
    return C.rounded(FE.realised_vol(two_contracts(spark, sf), ["entity"], "d", "c1", "rv").select("entity", "d", "rv"), 5)
