"""Query registry and the SQL text shared by the oracles.

A query is a function (spark, sf_dir) -> DataFrame. Its oracle is plain SQL on
the raw tables; common table expressions used by several oracles are kept here
once and prepended by `sql`.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


HELD: set[str] = set()


def cte(name: str, body: str, *deps: str, held: bool = False) -> str:
    """Register a common table expression; `held` ones are computed once by the SQL engine, however often they are read."""
    CTES[name] = (deps, body.strip())
    if held:
        HELD.add(name)
    return name


def sql(final: str, *deps: str) -> str:
    """Prepend the needed CTEs, in dependency order, to a final SELECT."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for d in deps:
        visit(d)
    if not seen:
        return final
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in HELD else ''}(\n{CTES[n][1]}\n)" for n in seen) + "\n" + final


def R(*names: str, digits: int = 6) -> str:
    """`round(x, 6) AS x` for every name (adding 0 removes the sign of a rounded -0)."""
    out = []
    for n in names:
        src, _, alias = n.partition(" AS ")
        out.append(f"round({src}, {digits}) + 0.0e0 AS {alias or src}")
    return ", ".join(out)




def erfc_sql(x: str) -> str:
    """erfc for x >= 0, same rational form as functions.columns.erfc_pos."""
    t = f"(1e0/(1e0+0.3275911e0*({x})))"
    return (
        f"((((((1.061405429e0*{t} - 1.453152027e0)*{t} + 1.421413741e0)*{t} - 0.284496736e0)*{t}"
        f" + 0.254829592e0)*{t})*exp(-(({x})*({x}))))"
    )


# --------------------------------------------------------------------------- shared views in SQL
cte("panel_raw", """
 SELECT p.p_brand AS entity, last_day(CAST(l.l_shipdate AS DATE)) AS month,
        CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE) AS pc,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q,
        CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE) AS dc,
        CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE) AS tc,
        CAST(count(*) FILTER (l_returnflag='R') AS DOUBLE) AS nr,
        CAST(count(*) FILTER (l_linestatus='O') AS DOUBLE) AS no_,
        CAST(count(*) AS DOUBLE) AS n
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1,2""")
cte("panel_sparse", """
 SELECT entity, month, (pc/100e0)/q AS px, (pc/100e0)/n AS px2, q AS qty, (dc/100e0)/n AS disc,
        (tc/100e0)/n AS tax, nr/n AS ret, no_/n AS nopen FROM panel_raw""", "panel_raw")
cte("panel_spine", """
 SELECT entity, last_day(CAST(g AS DATE)) AS month, CAST(row_number() OVER (PARTITION BY entity ORDER BY g) - 1 AS INTEGER) AS pos
 FROM (SELECT entity, unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS g
       FROM panel_sparse GROUP BY entity)""", "panel_sparse")
cte("panel", """
 SELECT s.entity, s.month, s.pos, p.px IS NULL AS filled,
  """ + ",\n  ".join(f"last_value(p.{c} IGNORE NULLS) OVER w AS {c}" for c in ("px", "px2", "qty", "disc", "tax", "ret", "nopen")) + """
 FROM panel_spine s LEFT JOIN panel_sparse p ON s.entity=p.entity AND s.month=p.month
 WINDOW w AS (PARTITION BY s.entity ORDER BY s.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "panel_spine", "panel_sparse")
cte("feat_all", """
 SELECT *, round(ret - lag(ret,3) OVER w,12) AS ret_d3, round(qty/lag(qty,3) OVER w - 1e0,12) AS qty_c3, round(px/lag(px,6) OVER w - 1e0,12) AS px_m6,
   CASE WHEN count(px) OVER w10 >= 10 THEN round(px/avg(px) OVER w10 - 1e0,12) END AS px_t10, lead(px,3) OVER w/px - 1e0 AS y
 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY pos),
   w10 AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "panel")
cte("fw0", """
 SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY entity ORDER BY pos) - 1 AS INTEGER) AS pos) FROM feat_all
 WHERE disc IS NOT NULL AND tax IS NOT NULL AND ret_d3 IS NOT NULL AND qty_c3 IS NOT NULL AND px_m6 IS NOT NULL AND px_t10 IS NOT NULL""", "feat_all")
cte("fw", """
 SELECT f.*, CASE WHEN y IS NULL THEN 'unknown' WHEN pos < c1 - 3 THEN 'learn' WHEN pos >= c1 AND pos < c2 - 3 THEN 'val'
              WHEN pos >= c2 THEN 'test' ELSE 'purged' END AS part
 FROM (SELECT *, CAST(floor(n_ev*0.6e0) AS INTEGER) AS c1, CAST(floor(n_ev*(0.6e0+0.2e0)) AS INTEGER) AS c2 FROM
        (SELECT *, count(y) OVER (PARTITION BY entity) AS n_ev, CAST(count(*) OVER (PARTITION BY entity) AS INTEGER) AS n_all FROM fw0)) f""", "fw0", held=True)
cte("fl", "\n UNION ALL ".join(
    f"SELECT entity, month, pos, '{c}' AS feature, {c} AS x, y, part, c1, n_all FROM fw"
    for c in ("disc", "tax", "ret_d3", "qty_c3", "px_m6", "px_t10")), "fw")
cte("daily_obs", """
 SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
   (CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0)/CAST(count(*) AS DOUBLE) AS value
 FROM orders GROUP BY 1,2""")
cte("vint", """
 SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(l_shipdate AS DATE) AS release_date, l_extendedprice AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("posn", """
 SELECT l_suppkey % 10 AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS week,
  CAST(sum(CASE WHEN l_returnflag='A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS long_,
  CAST(sum(CASE WHEN l_returnflag='R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS short_,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS oi
 FROM lineitem GROUP BY 1,2""")
cte("chain", """
 SELECT p_brand AS symbol, CASE WHEN p_partkey%2=0 THEN 'call' ELSE 'put' END AS type, CAST(p_size*4 AS INTEGER) AS dte,
  p_retailprice AS strike, CAST(p_partkey%97 AS DOUBLE)/100e0 AS iv, CAST(p_partkey%13 AS DOUBLE) AS oi, CAST(p_partkey%7 AS DOUBLE) AS vol, p_partkey AS row_id
 FROM part""")
