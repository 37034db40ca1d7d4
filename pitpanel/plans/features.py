"""Feature-construction queries (groups C and D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as AL
from ..operators import features as FE
from ..sources import views as V
from .registry import R, cte, query, sql

WSQL = "WINDOW w AS (PARTITION BY entity ORDER BY pos)"


def panel_query(name: str, exprs, text: dict, src: str = "panel", digits: int = 7):
    """Register a query that adds row-wise or windowed expressions to the panel."""
    cte(f"q_{name}", "SELECT entity, month, " + ", ".join(f"{t} AS {k}" for k, t in text.items()) + f" FROM {src} {WSQL}", src)

    @query(name, sql("SELECT entity, month, " + R(*text, digits=digits) + f" FROM q_{name}", f"q_{name}"))
    def run(spark, sf):
        p = V.monthly_panel(spark, sf)
        return C.rounded(p.select("entity", "month", *[e.alias(k) for k, e in exprs(C.by_entity("entity")).items()]), digits)

    run.__name__ = name
    return run


panel_query("diff_k", lambda w: {f"d{k}": C.diff("ret", k, w) for k in (3, 6)}, {f"d{k}": f"ret-lag(ret,{k}) OVER w" for k in (3, 6)})
KS = (1, 3, 4, 6, 12, 26, 52)
panel_query("pct_change_k", lambda w: {f"c{k}": C.pct_change("px", k, w) for k in KS}, {f"c{k}": f"px/lag(px,{k}) OVER w-1e0" for k in KS})
panel_query("safe_pct_change", lambda w: {"x": C.safe_pct_change("ret", 1, w)},
    {"x": "CASE WHEN abs(lag(ret,1) OVER w)>1e-12 THEN ret/lag(ret,1) OVER w-1e0 END"})
panel_query("clip", lambda w: {"x": C.clip(C.pct_change("qty", 3, w), -0.25, 0.4)}, {"x": "CASE WHEN qty/lag(qty,3) OVER w IS NOT NULL THEN least(greatest(qty/lag(qty,3) OVER w-1e0,-0.25e0),0.4e0) END"})
panel_query("ratio_mom", lambda w: {"x": C.ratio(C.ratio("px", "px2"), F.lag(C.ratio("px", "px2"), 3).over(w)) - 1.0}, {"x": "(px/px2)/lag(px/px2,3) OVER w-1e0"})


def _brent(w):
    own = F.when(F.substring("entity", 7, 1) != "2", F.col("px"))  # some entities lack the first source
    return AL.series_or(own, F.col("px2") / 25.0, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("px")


panel_query("spread", lambda w: {"real": F.col("disc") - F.col("tax"), "brent": _brent(w)},
    {"real": "disc-tax", "brent": "CASE WHEN count(CASE WHEN substr(entity,7,1)<>'2' THEN px END) OVER (PARTITION BY entity)>0 THEN CASE WHEN substr(entity,7,1)<>'2' THEN px END ELSE px2/25e0 END-px"})
panel_query("linear_combo", lambda w: {"crack": (2.0 * F.col("px") * 42.0 + F.col("px2") * 42.0) / 3.0 - F.col("qty")}, {"crack": "(2e0*px*42e0+px2*42e0)/3e0-qty"}, digits=4)
panel_query("basket_mean", lambda w: {"x": C.row_mean(C.pct_change("px", 3, w), C.pct_change("px2", 3, w), F.when(F.col("ret") > 0.3, C.pct_change("qty", 3, w)))},
    {"x": "list_avg(list_filter([px/lag(px,3) OVER w-1e0, px2/lag(px2,3) OVER w-1e0, CASE WHEN ret>0.3e0 THEN qty/lag(qty,3) OVER w-1e0 END], lambda v: v IS NOT NULL))"})


def _net_liquidity():
    third = F.when(F.col("tax") > 0.04, F.col("tax"))
    return F.col("px2") / 1000.0 - F.col("disc") - F.coalesce(third, F.lit(0.0))


_NL = "(px2/1000e0-disc-coalesce(CASE WHEN tax>0.04e0 THEN tax END,0e0))"
panel_query("net_liquidity", lambda w: {"yoy": C.pct_change(_net_liquidity(), 12, w)}, {"yoy": f"{_NL}/lag{_NL[:-1]},12) OVER w-1e0"})
panel_query("seasonal_dev_m", lambda w: {"x": FE.seasonal_deviation("qty", (12, 24, 36, 48, 60), w, "fraction")},
    {"x": "qty/(CASE WHEN len(list_filter([lag(qty,12) OVER w,lag(qty,24) OVER w,lag(qty,36) OVER w,lag(qty,48) OVER w,lag(qty,60) OVER w], lambda v: v IS NOT NULL))>=3 THEN list_avg(list_filter([lag(qty,12) OVER w,lag(qty,24) OVER w,lag(qty,36) OVER w,lag(qty,48) OVER w,lag(qty,60) OVER w], lambda v: v IS NOT NULL)) END)-1e0"})
panel_query("curve_slope", lambda w: {"s2": FE.curve_slope("px", "qty", 15.0), "chg": -FE.curve_slope("px", "px2", 3000.0)},
    {"s2": "CASE WHEN px>5 THEN least(greatest((px-qty)/px*100e0,-15e0),15e0) END", "chg": "-(CASE WHEN px>5 THEN least(greatest((px-px2)/px*100e0,-3000e0),3000e0) END)"}, digits=5)

ROLLS = ((3, 3), (4, 4), (7, 4), (12, 12), (30, 30), (90, 60), (365, 300))


@query("rolling_minp", sql("SELECT series_id, obs_date, " + ", ".join(
    f"round(CASE WHEN count(value) OVER w{n} >= {m} THEN {fn}(value) OVER w{n} END,6)+0e0 AS {a}{n}" for n, m in ROLLS for fn, a in (("avg", "m"), ("stddev_samp", "s")))
    + ", " + ", ".join(f"round(CASE WHEN count(value) OVER w30>=21 THEN {fn}(value) OVER w30 END,6)+0e0 AS {fn}30" for fn in ("min", "max", "sum"))
    + " FROM (SELECT series_id, obs_date, ln(value) AS value FROM daily_obs) WINDOW " + ", ".join(f"w{n} AS (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n, _ in ROLLS), "daily_obs"))
def rolling_minp(spark, sf):
    d, wd = V.daily_obs(spark, sf).withColumn("value", F.ln("value")), C.by_entity("series_id", order="obs_date")
    cols = [C.rolling(fn, "value", n, m, wd).alias(f"{a}{n}") for n, m in ROLLS for fn, a in ((F.avg, "m"), (F.stddev_samp, "s"))]
    cols += [C.rolling(fn, "value", 30, 21, wd).alias(f"{a}30") for fn, a in ((F.min, "min"), (F.max, "max"), (F.sum, "sum"))]
    return C.rounded(d.select("series_id", "obs_date", *cols))


cte("sahm1", "SELECT *, CASE WHEN count(ret) OVER w3>=3 THEN avg(ret) OVER w3 END AS m3 FROM panel WINDOW w3 AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "panel")
cte("sahm2", "SELECT entity, month, m3-CASE WHEN count(m3) OVER w=12 THEN min(m3) OVER w END AS x FROM sahm1 WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", "sahm1")


@query("sahm_gauge", sql("SELECT entity, month, " + R("x") + " FROM sahm2", "sahm2"))
def sahm_gauge(spark, sf):
    return C.rounded(FE.sahm_gauge(V.monthly_panel(spark, sf), "ret", C.by_entity("entity"), "x").select("entity", "month", "x"))


LAG5 = "[" + ",".join(f"lag(oi,{52 * k}) OVER w" for k in range(1, 6)) + "]"
cte("wk", f"SELECT entity, week, oi, list_filter({LAG5}, lambda v: v IS NOT NULL) AS past FROM posn WINDOW w AS (PARTITION BY entity ORDER BY week)", "posn")


@query("seasonal_dev", sql("SELECT entity, week, " + R("(oi/CASE WHEN len(past)>=3 THEN list_avg(past) END-1e0)*100e0 AS pct", "oi-CASE WHEN len(past)>=3 THEN list_avg(past) END AS gap", digits=5) + " FROM wk", "wk"))
def seasonal_dev(spark, sf):
    p, ww = V.weekly_positions(spark, sf), C.by_entity("entity", order="week")
    lags = [52 * k for k in range(1, 6)]
    return C.rounded(
        p.select(
            "entity", "week", FE.seasonal_deviation("oi", lags, ww).alias("pct"), FE.seasonal_deviation("oi", lags, ww, "difference").alias("gap")
        ),
        5,
    )


cte("dem", "SELECT entity, week, CASE WHEN count(long_) OVER w>=4 THEN avg(long_) OVER w END AS dem4 FROM posn WINDOW w AS (PARTITION BY entity ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "posn")


@query("cover_days", sql("SELECT p.entity, p.week, " + R("oi/nullif(dem4,0) AS cover") + " FROM posn p LEFT JOIN dem d ON p.entity=d.entity AND p.week=d.week", "posn", "dem"))
def cover_days(spark, sf):
    """Stock over four-week demand. Both series come from one aggregate, so aligning them needs no join."""
    p, ww = V.weekly_positions(spark, sf), C.by_entity("entity", order="week")
    return C.rounded(p.select("entity", "week", C.ratio("oi", C.rolling(F.avg, "long", 4, 4, ww)).alias("cover")))


cte("rollp", """SELECT *, (etf/lag(etf,1) OVER w-1e0) - (px/lag(px,1) OVER w-1e0) AS proxy, count(*) FILTER (ret>0.3e0) OVER (PARTITION BY entity) AS n_curve
 FROM (SELECT *, px2/25e0 AS etf FROM panel) """ + WSQL, "panel")


@query("roll_proxy", sql("SELECT entity, month, " + R("CASE WHEN n_curve>36 THEN NULL ELSE proxy END AS roll_proxy") + " FROM rollp", "rollp"))
def roll_proxy(spark, sf):
    """ETF change minus futures change, only where the real curve has too little history."""
    p = V.monthly_panel(spark, sf).withColumn("etf", F.col("px2") / 25.0)
    n_curve = F.count(F.when(F.col("ret") > 0.3, 1)).over(Window.partitionBy("entity"))
    w = C.by_entity("entity")
    proxy = C.pct_change("etf", 1, w) - C.pct_change("px", 1, w)
    return C.rounded(p.select("entity", "month", F.when(n_curve <= 36, proxy).alias("roll_proxy")))


# --------------------------------------------------------------------------- D: network and miner features
CHAIN = ("price", "mc", "rc", "supply", "iss", "fees", "hash", "addr", "stable", "sent")


def chain_daily(spark, sf):
    c, st = V.cents("o_totalprice"), F.col("o_orderstatus")
    g = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("d"))
    cnt = F.count(F.lit(1)).cast("double")
    g = g.agg(
        (F.sum(c) / 100.0 / cnt).alias("price"),
        (F.sum(c) / 100.0).alias("mc"),
        (F.sum(F.when(st == "F", c)) / 100.0).alias("rc"),
        cnt.alias("supply"),
        F.count(F.when(st == "O", 1)).cast("double").alias("iss"),
        F.count(F.when(st == "P", 1)).cast("double").alias("fees"),
        F.sum(F.col("o_custkey") % 97).cast("double").alias("hash"),
        F.sum(F.col("o_custkey") % 7).cast("double").alias("addr"),
        F.sum(F.col("o_orderkey") % 1009).cast("double").alias("stable"),
        (F.sum(F.col("o_custkey")) % 101).cast("double").alias("sent"),
    )
    return g


cte("cd", """SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0 AS mc,
 CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0/CAST(count(*) AS DOUBLE) AS price,
 CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) FILTER (o_orderstatus='F') AS DOUBLE)/100e0 AS rc, CAST(count(*) AS DOUBLE) AS supply,
 CAST(count(*) FILTER (o_orderstatus='O') AS DOUBLE) AS iss, CAST(count(*) FILTER (o_orderstatus='P') AS DOUBLE) AS fees,
 CAST(sum(o_custkey%97) AS DOUBLE) AS hash, CAST(sum(o_custkey%7) AS DOUBLE) AS addr, CAST(sum(o_orderkey%1009) AS DOUBLE) AS stable, CAST(sum(o_custkey)%101 AS DOUBLE) AS sent
 FROM orders GROUP BY 1,2""")
cte("cd1", "SELECT entity, d, " + ", ".join(f"CASE WHEN count({c}) OVER (PARTITION BY entity)>=365 THEN {c} END AS {c}" for c in CHAIN) + " FROM cd", "cd")


def _m(x, n, m, fn="avg"):
    w = f"(PARTITION BY entity ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w}>={m} THEN {fn}({x}) OVER {w} END"


cte("cd2", f"SELECT *, mc/nullif(iss,0) AS nvt, {_m('hash', 30, 30)} AS h30, {_m('hash', 60, 60)} AS h60, {_m('addr', 30, 30)} AS a30, {_m('fees', 30, 30)} AS f30, {_m('iss', 30, 30)} AS i30, {_m('stable', 7, 4)} AS s7 FROM cd1", "cd1")
_W = "(PARTITION BY entity ORDER BY d)"
cte("cd3", f"""SELECT entity, d, mc/nullif(rc,0) AS cap_ratio, (mc-rc)/{_m('mc', 100000, 365, 'stddev_samp')} AS cap_z, price/{_m('price', 200, 200)} AS px_200, iss/{_m('iss', 365, 300)} AS iss_rel,
 {_m('nvt', 90, 60)} AS nvt_90, (h30/h60-1e0)*100e0 AS ribbon, h30/lag(h30,90) OVER {_W}-1e0 AS hash_chg, a30/lag(a30,90) OVER {_W}-1e0 AS addr_chg, f30/nullif(f30+i30,0)*100e0 AS fee_share,
 addr/supply*100e0 AS active_share, s7/lag(s7,90) OVER {_W}-1e0 AS stable_chg, {_m('sent', 7, 4)} AS sent_7 FROM cd2""", "cd2")
CF = ("cap_ratio", "cap_z", "px_200", "iss_rel", "nvt_90", "ribbon", "hash_chg", "addr_chg", "fee_share", "active_share", "stable_chg", "sent_7")


@query("chain_features", sql("SELECT entity, d+1 AS avail_date, " + R(*CF, digits=4) + " FROM cd3", "cd3"))
def chain_features(spark, sf):
    """Computed on observation dates and lagged by one day at the end."""
    f = FE.chain_features(chain_daily(spark, sf))
    return C.rounded(f.select("entity", F.date_add("d", 1).alias("avail_date"), *CF), 4)
