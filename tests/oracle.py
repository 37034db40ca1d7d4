"""Compare registered queries with their SQL oracles: python tests/oracle.py [sf] [name-substring ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, text):
    """'' when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    cols = df.columns
    a = norm([tuple(r) for r in df.collect()], cols)
    cur = con.execute(text)
    dcols = [d[0] for d in cur.description]
    b = norm(cur.fetchall(), dcols)
    if sorted(cols) != sorted(dcols):
        return f"columns {sorted(cols)} vs {sorted(dcols)}", len(a)
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} vs {len(b)}; spark-only {len(sa - sb)} {sorted(sa - sb)[:3]}; sql-only {sorted(sb - sa)[:3]}", len(a)
    return "", len(a)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pitpanel.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pick = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    qs, osql = entry.queries(), entry.oracle_sql()
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if pick and not any(p in name for p in pick):
            continue
        t = time.time()
        try:
            if name in osql:
                msg, n = compare(spark, con, sf_dir, name, fn, osql[name])
            else:
                n, msg = len(fn(spark, sf_dir).collect()), ""
                name += " (rows only)"
            if n == 0:
                msg = "EMPTY " + msg
        except Exception as e:  # noqa: BLE001
            n, msg = -1, f"{type(e).__name__}: {str(e)[:450]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} n={n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failures:", bad)
