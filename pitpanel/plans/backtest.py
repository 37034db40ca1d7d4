"""Backtest queries (group M and the randomisation tests of group H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analogue as N
from ..operators import backtest as B
from ..operators import factors as FA
from ..operators import model as M
from ..operators import states as S
from ..operators import stats as ST
from ..operators import targets as T
from ..sources import views as V
from ..sources.store import materialise
from . import common as P
from .model import probabilities
from .registry import R, cte, query, sql
from .stats import start_sql

BPS = 10

# --------------------------------------------------------------------------- signals
SIGNALS = ("Rules", "Refit", "Analogues", "ML", "Rules + ML")
_E = "CASE {} WHEN 'Favorable' THEN 1e0 WHEN 'Neutral' THEN 0.5e0 ELSE 0e0 END"
cte("sig_r", "SELECT entity, month, verdict FROM a_vd", "a_vd")
cte("sig_w", "SELECT entity, month, verdict FROM (SELECT *, count(*) FILTER (learn) OVER (PARTITION BY entity, fold) AS nl FROM w_vd) WHERE nl>=36 AND pos>=fold", "w_vd")
cte("sig_a", "SELECT entity, month, CASE WHEN med>0 AND pos>=0.6e0 THEN 'Favorable' WHEN med<=0 AND pos<=0.4e0 THEN 'Unfavorable' ELSE 'Neutral' END AS verdict FROM wa", "wa")
cte("sig_m", "SELECT entity, month, CASE WHEN p-base<=-0.05e0 THEN 'Unfavorable' WHEN p-base>=0.05e0 THEN 'Favorable' ELSE 'Neutral' END AS verdict FROM prob9", "prob9")
cte("sig_u", f"""SELECT entity, month, 'Rules' AS signal, verdict FROM sig_r UNION ALL SELECT entity, month, 'Refit', verdict FROM sig_w UNION ALL SELECT entity, month, 'Analogues', verdict FROM sig_a
 UNION ALL SELECT entity, month, 'ML', verdict FROM sig_m UNION ALL SELECT entity, month, 'Rules + ML', CASE WHEN e>=0.75 THEN 'Favorable' WHEN e<=0.25 THEN 'Unfavorable' ELSE 'Neutral' END FROM (
  SELECT r.entity, r.month, ({_E.format('r.verdict')}+{_E.format('m.verdict')})/2e0 AS e FROM sig_r r JOIN sig_m m USING (entity, month))""", "sig_r", "sig_w", "sig_a", "sig_m")
cte("sig_c", f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity, month) AS k FROM sig_u) WHERE k={len(SIGNALS)}", "sig_u", held=True)


def combined(a: str, b: str):
    """Mean exposure of two verdicts back to a verdict."""
    e = (B.by_verdict(F.col(a), (1.0, 0.5, 0.0)) + B.by_verdict(F.col(b), (1.0, 0.5, 0.0))) / 2.0
    return F.when(e >= 0.75, S.FAV).when(e <= 0.25, S.UNF).otherwise(S.NEU)


def all_signals(spark, sf):
    """Five verdict sources on the months all of them cover (joins on the month in place of an intersection of indexes)."""

    def build():
        scored = probabilities(spark, sf).select("entity", "month", F.col("verdict").alias("r"), M.ml_verdict(F.col("p"), F.col("base"), 0.05).alias("m"))
        wf = P.enough(P.refit(spark, sf)[3], ["entity", "fold"]).filter(F.col("pos") >= F.col("fold")).select("entity", "month", F.col("verdict").alias("w"))
        ana = N.walk_forward(P.feature_frame(spark, sf), V.FEATURES, V.H).select("entity", "month", N.verdict(F.col("med"), F.col("pos_share")).alias("a"))
        j = scored.join(wf, ["entity", "month"]).join(ana, ["entity", "month"]).withColumn("c", combined("r", "m"))
        items = [F.struct(F.lit(n).alias("signal"), F.col(c).alias("verdict")) for n, c in zip(SIGNALS, ("r", "w", "a", "m", "c"), strict=True)]
        return j.withColumn("_s", F.explode(F.array(*items))).select("entity", "month", "_s.*")

    return materialise(spark, sf, "signals", V.PANEL_TABLES, build)


# --------------------------------------------------------------------------- market frame and signals
cte("mk", """SELECT f.*, r2.vol, m.ra, m.rb, coalesce(pow(1e0+f.disc*100e0/100e0,1e0/12e0)-1e0,0e0) AS rf, f.px_t10>0 AS trend FROM fw f JOIN r2 USING (entity, month)
 JOIN (SELECT entity, month, lead(px,1) OVER w/px-1e0 AS ra, lead(px2,1) OVER w/px2-1e0 AS rb FROM panel WINDOW w AS (PARTITION BY entity ORDER BY pos)) m USING (entity, month)""", "fw", "r2", "panel")
cte("bt", """SELECT m.entity, m.month, m.pos, m.ra, m.rb, m.rf, m.trend, m.vol, m.px, s.signal, s.verdict, CASE WHEN m.pos<m.c2 THEN 'val' ELSE 'test' END AS period
 FROM mk m JOIN sig_c s USING (entity,month) WHERE m.pos>=m.c1 AND m.ra IS NOT NULL AND m.rb IS NOT NULL""", "mk", "sig_c", held=True)


def _w(vals):
    return f"CASE verdict WHEN 'Favorable' THEN {vals[0]}e0 WHEN 'Neutral' THEN {vals[1]}e0 ELSE {vals[2]}e0 END"


_cap = "coalesce(CASE WHEN vol<>0 THEN least(greatest(0.5e0/vol,0e0),1e0) END,1e0)"
_legs = {n: (_w(a), _w(b)) for n, (a, b) in B.MAPS.items()}
_legs["Trend only"] = ("CASE WHEN trend THEN 1e0 ELSE 0e0 END", "0e0")
_legs["Macro + trend"] = ("CASE WHEN trend AND verdict<>'Unfavorable' THEN 1e0 ELSE 0e0 END", "0e0")
_legs["Vol-capped"] = (f"{_w((1.0, 0.5, 0.0))}*{_cap}", "0e0")
cte("wts", "SELECT *, 1e0-wa-wb AS wc FROM (" + " UNION ALL ".join(f"SELECT *, '{n}' AS strategy, {a} AS wa, {b} AS wb FROM bt" for n, (a, b) in _legs.items()) + ")", "bt")
LEGS = "(CASE WHEN wa=0 THEN 0e0 ELSE wa*ra END + CASE WHEN wb=0 THEN 0e0 ELSE wb*rb END + CASE WHEN wc=0 THEN 0e0 ELSE wc*rf END)"


def ret_cte(name: str, src: str, keys: str, bps: str, coll: str) -> str:
    return cte(name, f"""SELECT *, {LEGS} + {coll} - turn*{bps}/10000e0 AS ret FROM (
 SELECT *, coalesce(abs(wa-lag(wa) OVER w)+abs(wb-lag(wb) OVER w), wa+wb) AS turn FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY pos))""", src)


def perf_cte(name: str, src: str, keys: str) -> str:
    """Performance per key from a source with ret, rf, pos."""
    cte(f"{name}_e", f"SELECT *, product(1e0+ret) OVER (PARTITION BY {keys} ORDER BY pos) AS eq FROM {src}", src)
    cte(f"{name}_d", f"SELECT *, eq/max(eq) OVER (PARTITION BY {keys} ORDER BY pos)-1e0 AS dd FROM {name}_e", f"{name}_e")
    cte(f"{name}_a", f"SELECT {keys}, count(*) AS n, arg_max(eq,pos) AS eqn, stddev_samp(ret)*sqrt(12e0) AS vol, avg(ret-rf)*12e0 AS ex, sqrt(avg(pow(least(ret-rf,0e0),2)))*sqrt(12e0) AS dn, min(dd) AS max_dd FROM {name}_d GROUP BY {keys}", f"{name}_d")
    return cte(name, f"""SELECT {keys}, n, CASE WHEN n>=2 THEN pow(eqn,12e0/n)-1e0 END AS cagr, vol, CASE WHEN vol>0 THEN ex/vol END AS sharpe, CASE WHEN n>=2 AND dn>0 THEN ex/dn END AS sortino,
 CASE WHEN n>=2 AND max_dd<0 THEN (pow(eqn,12e0/n)-1e0)/abs(max_dd) END AS calmar, CASE WHEN n>=2 THEN max_dd END AS max_dd FROM {name}_a""", f"{name}_a")


PERF = ("cagr", "vol", "sharpe", "sortino", "calmar", "max_dd")


def market_frame(spark, sf):
    w = C.by_entity("entity")
    f = P.features_all(spark, sf).withColumn("px_r1", C.pct_change("px", 1, w))
    f = f.withColumns(
        {
            "vol": T.trailing_vol("px", w),
            "ra": C.forward_return("px", 1, w),
            "rb": C.forward_return("px2", 1, w),
            "rf": T.cash_rate(F.col("disc") * 100.0),
        }
    )
    f = T.split3(T.complete_case(f, V.FEATURES), "y", V.H, V.TRAIN, V.VAL)
    return f.withColumn("trend", F.col("px_t10") > 0)


def signal_rows(spark, sf, signals=SIGNALS):
    """Market rows from the validation start on, one copy per signal, on the months that all signals cover."""
    m = market_frame(spark, sf).join(all_signals(spark, sf).filter(F.col("signal").isin(*signals)), ["entity", "month"])
    m = m.filter((F.col("pos") >= F.col("c1")) & F.col("ra").isNotNull() & F.col("rb").isNotNull())
    return m.select(
        "entity", "month", "pos", "ra", "rb", "rf", "trend", "vol", "px", "signal", "verdict", F.when(F.col("pos") < F.col("c2"), "val").otherwise("test").alias("period")
    )


KEYS = ["entity", "signal", "strategy"]
FUTURES = lambda: (F.col("wa") + F.col("wb")) * F.col("rf")


def tested(spark, sf, signals=SIGNALS, strategies=B.STRATEGIES, bps=BPS):
    w = B.strategy_weights(signal_rows(spark, sf, signals), strategies)
    return B.portfolio_return(w, KEYS, F.lit(float(bps)), FUTURES())


@query("trend_vol", sql("SELECT entity, month, trend, " + R("vol") + " FROM mk", "mk"))
def trend_vol(spark, sf):
    return C.rounded(market_frame(spark, sf).select("entity", "month", "trend", "vol"))


@query("strategy_weights", sql("SELECT entity, month, signal, strategy, " + R("wa", "wb", "wc") + " FROM wts", "wts"))
def strategy_weights(spark, sf):
    return C.rounded(B.strategy_weights(signal_rows(spark, sf)).select("entity", "month", "signal", "strategy", "wa", "wb", "wc"))


ret_cte("rets", "wts", "entity, signal, strategy", "10e0", "(wa+wb)*rf")


@query("backtest", sql("SELECT entity, month, signal, strategy, " + R("turn", "ret") + " FROM rets WHERE ret IS NOT NULL", "rets"))
def backtest(spark, sf):
    return C.rounded(tested(spark, sf).select("entity", "month", "signal", "strategy", "turn", "ret"))


perf_cte("pf", "rets", "entity, signal, strategy, period")
cte("pf_t", "SELECT entity, signal, strategy, period, count(*) FILTER (turn>0) AS trades, avg(wa+wb) AS invested FROM rets GROUP BY ALL", "rets")


@query("perf", sql("SELECT entity, signal, strategy, period, n, trades, " + R(*PERF, "invested") + " FROM pf JOIN pf_t USING (entity, signal, strategy, period)", "pf", "pf_t"))
def perf(spark, sf):
    return C.rounded(B.performance(tested(spark, sf), [*KEYS, "period"], extra=B.trading_aggs()))


cte("bm0", "SELECT entity, pos, period, rf, ra+rf AS a, rb+rf AS b FROM bt WHERE signal='Rules'", "bt")
cte("bm1", """SELECT entity, pos, period, rf, 'Asset buy & hold' AS benchmark, a AS ret FROM bm0 UNION ALL SELECT entity, pos, period, rf, 'Alternative buy & hold', b FROM bm0
 UNION ALL SELECT entity, pos, period, rf, 'Fixed mix', 0.6e0*a+0.4e0*b FROM bm0 UNION ALL SELECT entity, pos, period, rf, 'Cash', rf FROM bm0""", "bm0")
perf_cte("bmp", "bm1", "entity, benchmark, period")


def benchmark_perf(spark, sf):
    b = B.benchmarks(signal_rows(spark, sf, ("Rules",)), 0.6, F.col("rf"))
    return B.performance(b, ["entity", "benchmark", "period"])


@query("bench_curves", sql("SELECT entity, benchmark, period, n, " + R(*PERF) + " FROM bmp", "bmp"))
def bench_curves(spark, sf):
    return C.rounded(benchmark_perf(spark, sf))


cte("smw", "SELECT * REPLACE (avg(wa) OVER w AS wa, avg(wb) OVER w AS wb, 1e0-avg(wa) OVER w-avg(wb) OVER w AS wc) FROM wts WINDOW w AS (PARTITION BY entity, signal, strategy, period)", "wts")
ret_cte("smr", "smw", "entity, signal, strategy, period", "0e0", "(wa+wb)*rf")
perf_cte("smp", "smr", "entity, signal, strategy, period")


@query("static_mix", sql("SELECT entity, signal, strategy, period, n, " + R("cagr", "vol", "sharpe", "max_dd") + " FROM smp", "smp"))
def static_mix(spark, sf):
    keys = [*KEYS, "period"]
    w = B.static_mix(B.strategy_weights(signal_rows(spark, sf)), keys)
    r = B.portfolio_return(w, keys, F.lit(0.0), FUTURES())
    return C.rounded(B.performance(r, keys).select(*keys, "n", "cagr", "vol", "sharpe", "max_dd"))


cte("csw", "SELECT w.*, bps FROM wts w CROSS JOIN (VALUES (0),(10),(50),(100)) v(bps)", "wts")
ret_cte("csr", "csw", "entity, signal, strategy, bps", "bps", "(wa+wb)*rf")
perf_cte("csp", "csr", "entity, signal, strategy, bps, period")


@query("cost_stress", sql("SELECT entity, signal, strategy, CAST(bps AS INTEGER) AS bps, period, " + R("cagr", "sharpe", "max_dd") + " FROM csp", "csp"))
def cost_stress(spark, sf):
    w = B.strategy_weights(signal_rows(spark, sf)).withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 10, 50, 100)])))
    keys = [*KEYS, "bps"]
    r = B.portfolio_return(w, keys, F.col("bps"), FUTURES())
    return C.rounded(B.performance(r, [*keys, "period"]).select(*keys, "period", "cagr", "sharpe", "max_dd"))


cte("imw", "SELECT w.*, impl FROM wts w CROSS JOIN (VALUES ('ETF'),('Futures')) v(impl)", "wts")
ret_cte("imr", "imw", "entity, signal, strategy, impl", "10e0", "CASE WHEN impl='Futures' THEN (wa+wb)*rf ELSE 0e0 END")
perf_cte("imp", "imr", "entity, signal, strategy, impl, period")


@query("impl_check", sql("SELECT entity, signal, strategy, impl, period, " + R("cagr", "sharpe", "max_dd") + " FROM imp", "imp"))
def impl_check(spark, sf):
    w = B.strategy_weights(signal_rows(spark, sf)).withColumn("impl", F.explode(F.array(F.lit("ETF"), F.lit("Futures"))))
    keys = [*KEYS, "impl"]
    coll = F.when(F.col("impl") == "Futures", FUTURES()).otherwise(0.0)
    r = B.portfolio_return(w, keys, F.lit(float(BPS)), coll)
    return C.rounded(B.performance(r, [*keys, "period"]).select(*keys, "period", "cagr", "sharpe", "max_dd"))


ROLL = 36
cte("rs", f"SELECT entity, month, signal, strategy, CASE WHEN count(*) OVER w>={ROLL} THEN avg(ret-rf) OVER w*12e0/nullif(stddev_samp(ret) OVER w*sqrt(12e0),0e0) END AS rs FROM rets WINDOW w AS (PARTITION BY entity, signal, strategy ORDER BY pos ROWS BETWEEN {ROLL - 1} PRECEDING AND CURRENT ROW)", "rets")


@query("rolling_sharpe", sql("SELECT entity, month, signal, strategy, round(rs,6)+0e0 AS rs FROM rs", "rs"))
def rolling_sharpe(spark, sf, n: int = ROLL):
    r = tested(spark, sf)
    return C.rounded(r.select("entity", "month", "signal", "strategy", B.rolling_sharpe(r, KEYS, n).alias("rs")))


@query("growth", sql("SELECT entity, month, signal, strategy, round(product(1e0+ret) OVER (PARTITION BY entity, signal, strategy ORDER BY pos),6)+0e0 AS growth FROM rets", "rets"))
def growth(spark, sf):
    r = tested(spark, sf)
    w = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return C.rounded(r.select("entity", "month", "signal", "strategy", C.compound("ret", w).alias("growth")))


cte("lb", """SELECT p.entity, p.signal, p.strategy, p.sharpe AS v, q.sharpe AS t FROM pf p JOIN pf q USING (entity, signal, strategy)
 WHERE p.period='val' AND q.period='test' AND p.n>=12 AND q.n>=12 AND (p.strategy<>'Trend only' OR p.signal='Rules')""", "pf")
cte("lb2", """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(v,9) DESC NULLS LAST, signal, strategy) AS place, CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY entity ORDER BY round(t,9) DESC NULLS LAST) END AS t_place FROM lb""", "lb")


@query("leaderboard", sql("""SELECT l.entity, signal, strategy, CAST(place AS INTEGER) AS place, CAST(t_place AS INTEGER) AS t_place, """ + R("v", "t") + """, coalesce(round(v,9)>round(bv.sharpe,9) AND round(t,9)>round(bt2.sharpe,9),false) AS beats,
 place=1 AS pick FROM lb2 l JOIN bmp bv ON bv.entity=l.entity AND bv.period='val' AND bv.benchmark='Asset buy & hold' JOIN bmp bt2 ON bt2.entity=l.entity AND bt2.period='test' AND bt2.benchmark='Asset buy & hold'""", "lb2", "bmp"))
def leaderboard(spark, sf):
    """Every signal x strategy ranked on validation; the test column only grades the pick."""
    p = B.performance(tested(spark, sf), [*KEYS, "period"])
    n = lambda k: F.max(F.when(F.col("period") == k, F.col("n")))
    s = lambda k: F.max(F.when(F.col("period") == k, F.col("sharpe")))
    g = p.groupBy(*KEYS).agg(s("val").alias("v"), s("test").alias("t"), n("val").alias("nv"), n("test").alias("nt"))
    g = g.filter((F.col("nv") >= 12) & (F.col("nt") >= 12) & ((F.col("strategy") != "Trend only") | (F.col("signal") == "Rules"))).drop("nv", "nt")
    b = benchmark_perf(spark, sf).filter(F.col("benchmark") == "Asset buy & hold").groupBy("entity").agg(s("val").alias("bv"), s("test").alias("bt"))
    w = Window.partitionBy("entity")
    place = F.row_number().over(w.orderBy(F.round("v", 9).desc_nulls_last(), "signal", "strategy"))
    t_place = F.when(F.col("t").isNotNull(), F.rank().over(w.orderBy(F.round("t", 9).desc_nulls_last())))
    g = g.withColumns({"place": place, "t_place": t_place, "pick": place == 1}).join(b, "entity")
    beats = F.coalesce((F.round("v", 9) > F.round("bv", 9)) & (F.round("t", 9) > F.round("bt", 9)), F.lit(False))
    return C.rounded(g.withColumn("beats", beats).drop("bv", "bt"))


# --------------------------------------------------------------------------- signals in common
@query("signal_union", sql("SELECT entity, month, signal, verdict FROM sig_c", "sig_c"))
def signal_union(spark, sf):
    return all_signals(spark, sf)


cte("sigcmp", "SELECT entity, signal, count(*) FILTER (verdict='Favorable') AS n_fav, count(*) FILTER (verdict='Unfavorable') AS n_unf, (avg(y) FILTER (verdict='Favorable')-avg(y) FILTER (verdict='Unfavorable'))*100 AS d FROM sig_c JOIN fw USING (entity, month) WHERE part='test' GROUP BY 1,2", "sig_c", "fw")


@query("signal_compare", sql("SELECT entity, signal, n_fav, n_unf, CASE WHEN n_fav>=3 AND n_unf>=3 THEN round(d,6)+0e0 END AS spread FROM sigcmp", "sigcmp"))
def signal_compare(spark, sf):
    fw = P.feature_frame(spark, sf).filter(F.col("part") == "test").select("entity", "month", "y")
    return C.rounded(S.favorable_spread(all_signals(spark, sf).join(fw, ["entity", "month"]), ["entity", "signal"]))


# --------------------------------------------------------------------------- circular-shift null
DRAWS = 300
cte("sn_b", "SELECT *, row_number() OVER (PARTITION BY entity, signal, strategy ORDER BY pos)-1 AS i, count(*) OVER (PARTITION BY entity, signal, strategy) AS l FROM wts WHERE strategy IN ('Scaled','Rotate')", "wts", held=True)
cte("sn_k", f"""SELECT entity, signal, strategy, rep, lo+{start_sql('greatest(l-lo,lo+1)-lo', 'rep', '0')} AS k FROM (SELECT DISTINCT entity, signal, strategy, CAST(l AS BIGINT) AS l, CAST(greatest(6,l//10) AS BIGINT) AS lo, CAST(rep AS BIGINT) AS rep FROM sn_b, range({DRAWS}) r(rep))""", "sn_b")
cte("sn_w", """SELECT b.entity, b.signal, b.strategy, k.rep, b.pos, b.i, b.ra, b.rb, b.rf, b.period, s.wa, s.wb, 1e0-s.wa-s.wb AS wc FROM sn_b b JOIN sn_k k USING (entity, signal, strategy)
 JOIN sn_b s ON s.entity=b.entity AND s.signal=b.signal AND s.strategy=b.strategy AND s.i=((b.i-k.k)%b.l+b.l)%b.l""", "sn_b", "sn_k")
ret_cte("sn_r", "sn_w", "entity, signal, strategy, rep", "10e0", "(wa+wb)*rf")
cte("sn", "SELECT entity, signal, strategy, rep, CASE WHEN stddev_samp(ret)*sqrt(12e0)>1e-12 THEN avg(ret-rf)*12e0/(stddev_samp(ret)*sqrt(12e0)) END AS s FROM sn_r WHERE period='test' GROUP BY 1,2,3,4", "sn_r", held=True)


def null_scores(spark, sf):
    w = B.strategy_weights(signal_rows(spark, sf), ("Scaled", "Rotate"))
    return B.shifted_sharpe(w, KEYS, DRAWS, float(BPS), F.col("period") == "test", F.col("rf"))


@query("shift_null", sql("SELECT entity, signal, strategy, CAST(rep AS INTEGER) AS rep, CAST(k AS INTEGER) AS shift, round(s,6)+0e0 AS null_sharpe FROM sn JOIN sn_k USING (entity, signal, strategy, rep)", "sn", "sn_k"))
def shift_null(spark, sf):
    return C.rounded(null_scores(spark, sf))


@query("perm_p", sql("""SELECT entity, signal, strategy, count(s) AS n_null, """ + R("(count(*) FILTER (round(s,9)>=o)+1)/(count(s)+1e0) AS p", "quantile_cont(round(s,9),0.5) AS null_median", "quantile_cont(round(s,9),0.95) AS null_p95") + """
 FROM sn JOIN (SELECT entity, signal, strategy, round(sharpe,9) AS o FROM pf WHERE period='test') USING (entity, signal, strategy) WHERE o IS NOT NULL GROUP BY 1,2,3""", "sn", "pf"))
def perm_p(spark, sf):
    obs = B.performance(tested(spark, sf, SIGNALS, ("Scaled", "Rotate")), [*KEYS, "period"]).filter(F.col("period") == "test")
    obs = obs.select(*KEYS, F.round("sharpe", 9).alias("obs")).filter(F.col("obs").isNotNull())
    null = null_scores(spark, sf).withColumn("null_sharpe", F.round("null_sharpe", 9))
    return C.rounded(ST.perm_p(null.join(obs, KEYS), KEYS, "null_sharpe", "obs"))


@query("variant_ablation")
def variant_ablation(spark, sf):
    """Favorable minus Unfavorable on the test rows with plain indicators and with merged factors (thresholds x aligned or not)."""
    fw = P.feature_frame(spark, sf)
    learn = F.col("part") == "learn"
    base = T.long_form(fw, V.FEATURES, ("entity", "month", "pos", "y", "part"))
    pairs = ST.spearman_pairs(fw.filter(learn), V.FEATURES).withColumn("thr", F.explode(F.array(*map(F.lit, (0.5, 0.6, 0.7, 0.8)))))
    table = FA.factor_table(pairs, V.FEATURES, "thr", keys=("entity", "thr"))
    table = table.withColumn("aligned", F.explode(F.array(F.lit(True), F.lit(False))))
    name = F.concat_ws(" ", F.lit("factors"), F.col("thr").cast("string"), F.when(F.col("aligned"), "aligned").otherwise("raw"))
    table = table.select("entity", "feature", "factor", F.when(F.col("aligned"), F.col("sign")).otherwise(1.0).alias("sign"), name.alias("variant"))
    keys, carry = ["entity", "variant"], ("y", "part")
    merged = FA.factor_scores(base, table, learn, keys, carry).withColumnRenamed("factor", "feature")
    plain = base.withColumn("variant", F.lit("indicators")).select(merged.columns)
    rows = plain.unionByName(merged).withColumn("learn", learn)
    sc = S.run_rules(rows, keys, V.H, P.CFG, ("y", "learn", "part"))[3]
    return C.rounded(S.favorable_spread(sc.filter(F.col("part") == "test"), keys))
