"""Landing queries (group A).

Payload text is built from the tables and parsed back by the production
parsers, so the work grows with the tables and the oracle is the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as AL
from ..sources import landed as L
from ..sources import paged as PG
from ..sources import views as V
from .registry import R, cte, query, sql


def pages(spark, sf, bad_day: int = 13):
    """One payload per (series, month), at most 31 observations; bad values are '.', revisions arrive later."""
    d = V.daily_obs(spark, sf)
    text = F.when(F.dayofmonth("obs_date") == bad_day, ".").otherwise(F.col("value").cast("string"))
    first = d.withColumn("text", text).withColumn("seq", F.lit(1))
    late = d.filter(F.dayofmonth("obs_date") == 1).withColumn("text", (F.col("value") + 1.0).cast("string")).withColumn("seq", F.lit(2))
    return first.unionByName(late)


cte("land", """SELECT series_id, obs_date, value + CASE WHEN day(obs_date)=1 THEN 1e0 ELSE 0e0 END AS value FROM daily_obs WHERE day(obs_date)<>13""", "daily_obs")
LAND = sql("SELECT series_id, obs_date, " + R("value") + " FROM land", "land")


@query("ingest_macro_json", LAND)
def ingest_macro_json(spark, sf):
    item = F.struct(F.col("obs_date").cast("string").alias("date"), F.col("text").alias("value"))
    p = pages(spark, sf).groupBy("series_id", "seq", F.trunc("obs_date", "MM").alias("m"))
    p = p.agg(F.to_json(F.struct(F.collect_list(item).alias("observations"))).alias("payload"))
    return C.rounded(L.parse_macro_json(p, ["series_id"], "payload", "seq"))


@query("ingest_macro_csv", LAND)
def ingest_macro_csv(spark, sf):
    p = pages(spark, sf).withColumn("line", F.concat_ws(",", "obs_date", "text", F.lit("ignored")))
    return C.rounded(L.parse_macro_csv(p, ["series_id"], "line", "seq"))


@query("ingest_chain", LAND)
def ingest_chain(spark, sf):
    stamp = F.concat(F.col("obs_date").cast("string"), F.lit("T05:30:00Z"))
    item = F.struct(stamp.alias("time"), F.col("text").alias("value"))
    p = pages(spark, sf).groupBy("series_id", "seq", F.trunc("obs_date", "MM").alias("m"))
    p = p.agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    return C.rounded(L.parse_metric_json(p, ["series_id"], "payload", "seq"))


cte("interp", """SELECT series_id, CAST(g AS DATE) AS obs_date, CASE WHEN k=0 THEN value WHEN k<=10 THEN value+(nv-value)*(CAST(k AS DOUBLE)/span) END AS value FROM (
  SELECT *, date_diff('day', obs_date, CAST(g AS DATE)) AS k FROM (
   SELECT *, date_diff('day', obs_date, nd) AS span, unnest(CASE WHEN nd IS NULL THEN [CAST(obs_date AS TIMESTAMP)] ELSE generate_series(CAST(obs_date AS TIMESTAMP), CAST(nd AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY) END) AS g FROM (
    SELECT *, lead(obs_date) OVER w AS nd, lead(value) OVER w AS nv FROM daily_obs WINDOW w AS (PARTITION BY series_id ORDER BY obs_date))))""", "daily_obs")
INTERP = sql("SELECT series_id, obs_date, value FROM interp", "interp")


@query("ingest_chart", INTERP)
def ingest_chart(spark, sf):
    item = F.struct(F.unix_seconds(F.col("obs_date").cast("timestamp")).alias("x"), F.col("value").alias("y"))
    p = V.daily_obs(spark, sf).groupBy("series_id", F.trunc("obs_date", "MM").alias("m"))
    p = p.agg(F.to_json(F.struct(F.collect_list(item).alias("values"))).alias("payload")).withColumn("seq", F.lit(1))
    return L.parse_chart_json(p, ["series_id"], "payload", "seq")


@query("interpolate_gap", INTERP)
def interpolate_gap(spark, sf):
    return AL.interpolate_days(V.daily_obs(spark, sf), ["series_id"], "obs_date", "value")


cte("sheets", "SELECT series_id, obs_date, value FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM daily_obs) WHERE n>=100", "daily_obs")


@query("ingest_index_csv", sql("SELECT series_id, obs_date, round(value,6)+0e0 AS value FROM sheets", "sheets"))
def ingest_index_csv(spark, sf):
    """A sheet per series, of which those with fewer than 100 rows count as failed."""
    d = V.daily_obs(spark, sf)
    sheet = d.select("series_id", F.col("obs_date").cast("string").alias(" Month "), F.col("value").cast("string").alias("GPR"))
    return C.rounded(L.with_min_rows(L.index_columns(sheet, "gpr", ("series_id",)), ["series_id"], 100))


@query("ingest_user_csv", sql("SELECT series_id, obs_date, " + R("value") + " FROM land WHERE series_id IN (SELECT series_id FROM land GROUP BY 1 HAVING count(*)>=20)", "land"))
def ingest_user_csv(spark, sf):
    p = pages(spark, sf).withColumn("line", F.concat_ws(",", "obs_date", "text"))
    return C.rounded(L.with_min_rows(L.parse_macro_csv(p, ["series_id"], "line", "seq"), ["series_id"], 20))


cte("first_rel", """SELECT series_id, obs_date, release_date, value FROM (
 SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY release_date, value) AS rn FROM vint WHERE value IS NOT NULL) WHERE rn=1""", "vint")


@query("first_release", sql("SELECT series_id, obs_date, release_date, " + R("value") + " FROM first_rel", "first_rel"))
def first_release(spark, sf):
    return C.rounded(L.first_release(V.vintages(spark, sf)))


TICKERS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "other", "5-LOW": "low", "6-NONE": "absent"}


@query("prices_wide", sql("SELECT obs_date AS d, " + ", ".join(
    f"round(max(value) FILTER (series_id='{k}' AND n>=100),6)+0e0 AS {v}" for k, v in TICKERS.items()) + " FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM daily_obs) GROUP BY 1", "daily_obs"))
def prices_wide(spark, sf):
    return C.rounded(L.prices_wide(V.daily_obs(spark, sf), "obs_date", "series_id", "value", TICKERS))


CONTRACT_ROWS = 500


@query("pivot_contracts", sql("SELECT last_day(obs_date) AS period, " + ", ".join(
    f"round(avg(value) FILTER (series_id='{k}'),7)+0e0 AS {v}" for k, v in TICKERS.items()) + f""" FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value FROM orders)) WHERE n>={CONTRACT_ROWS} GROUP BY 1"""))
def pivot_contracts(spark, sf):
    """Contracts side by side; one with too few rows counts as failed and is an empty column."""
    mapping = F.create_map(*[F.lit(x) for kv in TICKERS.items() for x in kv])
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.last_day("o_orderdate").alias("period"), F.col("o_totalprice").alias("value"))
    enough = o.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONTRACT_ROWS).select("series_id")
    d = o.join(enough, "series_id").select("period", mapping[F.col("series_id")].alias("c"), "value")
    return C.rounded(d.groupBy("period").pivot("c", list(TICKERS.values())).agg(F.avg("value")), 7)


PAGE = 200


@query("paged_results", sql("SELECT series_id, obs_date, round(value,6)+0e0 AS value FROM daily_obs", "daily_obs"))
def paged_results(spark, sf):
    """Every series as pages of a landed result, read back page by page."""
    at = PG.land(V.daily_obs(spark, sf), "series_id", "obs_date", PAGE)
    rows = PG.page_rows(PG.read_pages(spark, at), "obs_date date, value double")
    return C.rounded(rows.withColumnRenamed("result", "series_id"))


@query("missing_pages", sql(f"""SELECT series_id, CAST(page*{PAGE} AS BIGINT) AS "offset", CAST(least((page+1)*{PAGE}, n) AS BIGINT) AS until FROM (
 SELECT series_id, count(*) AS n, unnest(range(CAST(ceil(count(*)/{PAGE}e0) AS BIGINT))) AS page FROM daily_obs GROUP BY 1) WHERE (page+length(series_id))%3=1 AND n>{PAGE}""", "daily_obs"))
def missing_pages(spark, sf):
    """Which rows of a result are not covered by the pages that have arrived; every third page is lost here."""
    obs = V.daily_obs(spark, sf)
    lost = ((F.col("page") + F.length("result")) % 3 == 1) & (F.col("total") > PAGE)
    return PG.missing_pages(PG.read_pages(spark, PG.land(obs, "series_id", "obs_date", PAGE, lost))).withColumnRenamed("result", "series_id")


@query("drop_forecast_rows", sql("SELECT series_id, last_day(obs_date) AS period, count(*) AS n, " + R("avg(value) AS value")
    + " FROM daily_obs WHERE obs_date < DATE '2000-06-01' GROUP BY ALL", "daily_obs"))
def drop_forecast_rows(spark, sf, as_of: str = "2000-06-15"):
    """Months up to the one before `as_of`; later rows of an outlook are forecasts."""
    d = V.daily_obs(spark, sf).filter(F.col("obs_date") < F.trunc(F.to_date(F.lit(as_of)), "MM"))
    return C.rounded(d.groupBy("series_id", F.last_day("obs_date").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


#: Rows below which a whole source counts as failed.
SOURCE_ROWS = 200
cte("pegged", """SELECT * FROM (SELECT CAST(ts AS DATE) AS d,
 coalesce(TRY_CAST(json_extract_string(j,'$.v.pegged') AS DOUBLE), TRY_CAST(json_extract_string(j,'$.v') AS DOUBLE)) AS v FROM (
 SELECT ts, CASE WHEN event_id%3=0 THEN '{"v":{"pegged":'||json_extract_string(props,'$.k')||'}}' WHEN event_id%3=1 THEN '{"v":'||json_extract_string(props,'$.k')||'}'
 ELSE '{"v":null}' END AS j FROM events)) WHERE v>0""", held=True)


def enough_rows(df, need: int = SOURCE_ROWS):
    """All rows of a source, or none when it has too few: the number is a scalar subquery."""
    return df.filter(df.agg(F.count(F.lit(1))).scalar() >= need)


@query("json_struct_or_scalar", sql(f"SELECT d, round(sum(v),6)+0e0 AS total, count(*) AS n FROM pegged WHERE (SELECT count(*) FROM pegged)>={SOURCE_ROWS} GROUP BY d", "pegged"))
def json_struct_or_scalar(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    payload = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v":{"pegged":'), k, F.lit("}}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"v":'), k, F.lit("}")))
        .otherwise('{"v":null}')
    )
    v = e.select(F.to_date("ts").alias("d"), payload.alias("j")).select("d", L.number_or_struct("j", "v", "pegged").alias("v"))
    return C.rounded(enough_rows(v.filter(C.finite("v") > 0)).groupBy("d").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")))


@query("range_filter", f"SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, round(max(value),6)+0e0 AS hi FROM events WHERE value BETWEEN 0 AND 20 AND (SELECT count(*) FROM events WHERE value BETWEEN 0 AND 20)>={SOURCE_ROWS} GROUP BY ALL")
def range_filter(spark, sf):
    e = enough_rows(V.table(spark, sf, "events").filter(F.col("value").between(0, 20)))
    return C.rounded(e.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi")))


@query("clean_series", """SELECT event_type AS series_id, obs_date, round(value,6)+0e0 AS value FROM (
 SELECT event_type, CAST(ts AS DATE) AS obs_date, value, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn
 FROM events WHERE value>0 AND event_id%7<>0) WHERE rn=1""")
def clean_series(spark, sf):
    e = V.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    rows = e.select(F.col("event_type").alias("series_id"), "ts", text.alias("text"), "event_id")
    return C.rounded(L.clean_series(rows, ["series_id"], "ts", "text", "event_id", positive=True))


cte("prov", """SELECT series_id AS metric, 1 AS priority, obs_date, value FROM daily_obs WHERE series_id < '3'
 UNION ALL SELECT series_id, 2, obs_date, value*2e0 FROM daily_obs WHERE series_id > '2'""", "daily_obs")


@query("source_fallback", sql("SELECT metric, CAST(priority AS INTEGER) AS priority, obs_date, round(value,6)+0e0 AS value FROM prov p WHERE priority=(SELECT min(priority) FROM prov q WHERE q.metric=p.metric)", "prov"))
def source_fallback(spark, sf):
    d = V.daily_obs(spark, sf).withColumnRenamed("series_id", "metric")
    a = d.filter(F.col("metric") < "3").withColumn("priority", F.lit(1))
    b = d.filter(F.col("metric") > "2").withColumn("priority", F.lit(2)).withColumn("value", F.col("value") * 2.0)
    return C.rounded(L.source_fallback(a.unionByName(b)).select("metric", "priority", "obs_date", "value"))


@query("derived_fallback", """SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS d,
 round(greatest(CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0 - CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) FILTER (o_orderstatus='F') AS DOUBLE)/50e0,0e0),6)+0e0 AS issuance
 FROM orders GROUP BY 1,2 HAVING count(*) FILTER (o_orderstatus='F')>0""")
def derived_fallback(spark, sf):
    """Issuance = max(revenue - fees, 0), only where fees are known."""
    g = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("d"))
    c = V.cents("o_totalprice")
    g = g.agg((F.sum(c) / 100.0).alias("rev"), (F.sum(F.when(F.col("o_orderstatus") == "F", c)) / 50.0).alias("fee"))
    return C.rounded(g.filter(F.col("fee").isNotNull()).select("entity", "d", F.greatest(F.col("rev") - F.col("fee"), F.lit(0.0)).alias("issuance")))


#: The series that stands in for each one on days without a price.
BACKFILL = dict(zip(list(TICKERS)[:5], (*list(TICKERS)[1:5], list(TICKERS)[0]), strict=True))
cte("bf", "SELECT a.series_id, x.d FROM (SELECT DISTINCT series_id FROM daily_obs) a CROSS JOIN (SELECT DISTINCT obs_date AS d FROM daily_obs) x", "daily_obs")


@query("price_backfill", sql("SELECT f.series_id, f.d, round(coalesce(a.value,b.value),6)+0e0 AS price FROM bf f JOIN (VALUES " + ",".join(f"('{k}','{v}')" for k, v in BACKFILL.items()) + """) m(series_id, other) USING (series_id)
 LEFT JOIN daily_obs a ON a.series_id=f.series_id AND a.obs_date=f.d LEFT JOIN daily_obs b ON b.series_id=m.other AND b.obs_date=f.d WHERE coalesce(a.value,b.value) IS NOT NULL""", "bf", "daily_obs"))
def price_backfill(spark, sf):
    """Every series, filled with its stand-in's price on the days on which it has none itself: one aggregate, no join."""
    d = V.daily_obs(spark, sf)
    served = F.create_map(*[F.lit(x) for k, v in BACKFILL.items() for x in (v, k)])
    roles = F.array(F.struct(F.col("series_id"), F.lit(0).alias("rank")), F.struct(served[F.col("series_id")].alias("series_id"), F.lit(1).alias("rank")))
    rows = d.select(F.explode(roles).alias("r"), F.col("obs_date").alias("d"), "value").select("r.*", "d", "value").filter("series_id is not null")
    return C.rounded(rows.groupBy("series_id", "d").agg(F.min_by("value", "rank").alias("price")))


@query("standin_switch", sql("""SELECT entity, CASE WHEN n>=80 THEN 'macro' ELSE 'standin' END AS source, month, round(CASE WHEN n>=80 THEN disc ELSE ln(px2) END,8)+0e0 AS x
 FROM (SELECT *, CAST(count(*) FILTER (ret>0.3e0) OVER (PARTITION BY entity) AS BIGINT)*2 AS n FROM panel)""", "panel"))
def standin_switch(spark, sf):
    """When the anchor series has too little coverage the whole entity falls back to its stand-in."""
    from pyspark.sql import Window

    p = V.monthly_panel(spark, sf)
    n = F.count(F.when(F.col("ret") > 0.3, 1)).over(Window.partitionBy("entity")) * 2
    p = p.withColumn("source", F.when(n >= 80, "macro").otherwise("standin"))
    x = F.when(F.col("source") == "macro", F.col("disc")).otherwise(F.ln("px2"))
    return C.rounded(p.select("entity", "source", "month", x.alias("x")), 8)


@query("missing_sources", """SELECT p_brand AS entity, s AS series_id FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (VALUES ('ECONOMY'),('PROMO'),('STANDARD'),('SMALL'),('NONE')) v(s)
 EXCEPT SELECT p_brand, p_type FROM part""")
def missing_sources(spark, sf):
    expected = F.explode(F.array(*[F.lit(s) for s in ("ECONOMY", "PROMO", "STANDARD", "SMALL", "NONE")]))
    part = V.table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("series_id")).distinct()
    return part.select("entity").distinct().withColumn("series_id", expected).join(part, ["entity", "series_id"], "left_anti")


@query("min_rows_guard", """SELECT event_type AS series_id, count(*) AS n, CAST(need AS INTEGER) AS need, CASE WHEN count(*)>=need THEN 'loaded' ELSE 'too few rows' END AS status
 FROM events LEFT JOIN (VALUES ('click',100),('view',200),('error',500),('purchase',5000)) t(event_type,need) USING (event_type) GROUP BY event_type, need""")
def min_rows_guard(spark, sf):
    need = F.create_map(*[F.lit(x) for kv in (("click", 100), ("view", 200), ("error", 500), ("purchase", 5000)) for x in kv])
    g = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("need", need[F.col("series_id")])
    return g.withColumn("status", F.when(F.col("n") >= F.col("need"), "loaded").otherwise("too few rows"))


@query("append_dedupe_log", """SELECT d, event_type, round(value,6)+0e0 AS value FROM (SELECT CAST(ts AS DATE) AS d, event_type, value,
 row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY CASE WHEN event_id%5=0 THEN 1 ELSE 0 END DESC, event_id DESC) AS rn FROM events) WHERE rn=1""")
def append_dedupe_log(spark, sf):
    e = V.table(spark, sf, "events").select(F.to_date("ts").alias("d"), "event_type", "value", "event_id")
    old, new = e.filter(F.col("event_id") % 5 != 0), e.filter(F.col("event_id") % 5 == 0)
    return C.rounded(L.append_log(old, new, ["d", "event_type"], "event_id", ["value"]))


cte("hol", """SELECT DISTINCT CASE dayofweek(h) WHEN 6 THEN h-1 WHEN 0 THEN h+1 ELSE h END AS h FROM (
  SELECT make_date(CAST(y AS BIGINT),m,dd) AS h FROM generate_series(1990,2030) t(y), (VALUES (1,1,1),(6,19,2021),(7,4,1),(11,11,1),(12,25,1)) f(m,dd,since) WHERE y>=since
  UNION ALL SELECT d FROM (SELECT CAST(g AS DATE) AS d, row_number() OVER (PARTITION BY year(g), month(g), dayofweek(g) ORDER BY g) AS k,
    row_number() OVER (PARTITION BY year(g), month(g), dayofweek(g) ORDER BY g DESC) AS kr FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY) t(g))
   WHERE (month(d)=1 AND dayofweek(d)=1 AND k=3) OR (month(d)=2 AND dayofweek(d)=1 AND k=3) OR (month(d)=5 AND dayofweek(d)=1 AND kr=1)
      OR (month(d)=9 AND dayofweek(d)=1 AND k=1) OR (month(d)=10 AND dayofweek(d)=1 AND k=2) OR (month(d)=11 AND dayofweek(d)=4 AND k=4))""")
cte("cal", """SELECT d, hh, bd, CAST(sum(CASE WHEN bd THEN 1 ELSE 0 END) OVER (ORDER BY d) AS BIGINT) AS bdn FROM (
  SELECT CAST(g AS DATE) AS d, h.h IS NOT NULL AS hh, h.h IS NULL AND dayofweek(g) BETWEEN 1 AND 5 AS bd
  FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) t(g) LEFT JOIN hol h ON h.h=CAST(g AS DATE))""", "hol")
cte("bdays", "SELECT d, bdn FROM cal WHERE bd", "cal")
cte("rel_cal", """SELECT week, min(b.d) AS rel FROM (SELECT week, week+3+CASE WHEN EXISTS (SELECT 1 FROM hol WHERE h BETWEEN week-1 AND week+3) THEN 1 ELSE 0 END AS x
  FROM (SELECT DISTINCT week FROM posn)) q JOIN bdays b ON b.d>=q.x AND b.d<=q.x+12 GROUP BY week""", "posn", "hol", "bdays")


@query("release_calendar", sql("SELECT entity, week, rel AS release FROM posn JOIN rel_cal USING (week)", "posn", "rel_cal"))
def release_calendar(spark, sf):
    from ..operators import calendar as K

    return V.weekly_positions(spark, sf).select("entity", "week", K.report_release(F.col("week")).alias("release"))


@query("net_position", sql("""SELECT entity, rel AS avail_date, week, round(v,6)+0e0 AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY entity, rel ORDER BY week DESC) AS rn FROM (SELECT *, (long_-short_)/oi*100e0 AS v, count(*) OVER (PARTITION BY entity) AS n FROM posn WHERE oi<>0)
 JOIN rel_cal USING (week) WHERE n>=100) WHERE rn=1""", "posn", "rel_cal"))
def net_position(spark, sf):
    return C.rounded(L.net_position(V.weekly_positions(spark, sf)))


@query("business_calendar", sql("""SELECT d, n_orders, hh AS holiday, bd AS business, (SELECT min(b.d) FROM bdays b WHERE b.d>=c.d AND b.d<=c.d+12) AS next_open,
 CAST(bdn - coalesce((SELECT max(e.bdn) FROM cal e WHERE e.d = CAST(date_trunc('month', c.d) AS DATE)-1),0) AS INTEGER) AS bd_of_month
 FROM cal c JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n_orders FROM orders GROUP BY 1) USING (d)""", "cal", "bdays"))
def business_calendar(spark, sf):
    from ..operators import calendar as K

    o = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n_orders"))
    d = F.col("d")
    return o.select(
        "d",
        "n_orders",
        K.is_holiday(d).alias("holiday"),
        K.is_business_day(d).alias("business"),
        K.next_business_day(d).alias("next_open"),
        F.size(F.filter(F.sequence(F.trunc(d, "MM"), d), K.is_business_day)).alias("bd_of_month"),
    )


@query("contract_expiry", sql("""SELECT m AS month, n_orders, (SELECT e.d FROM bdays e WHERE e.bdn=(SELECT c.bdn FROM cal c WHERE c.d=m+24)-3) AS expiry
 FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n_orders FROM orders GROUP BY 1)""", "cal", "bdays"))
def contract_expiry(spark, sf):
    from ..operators import calendar as K

    o = V.table(spark, sf, "orders").groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "MM")).alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))
    return o.withColumn("expiry", K.contract_expiry(F.col("month")))
