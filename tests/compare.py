"""Runs registered queries beside their oracle SQL and reports differences.

python tests/compare.py [sf folder] [name ...]
"""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def differences(spark_df, con, sql) -> list[str]:
    left, names = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right, other = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return [f"columns {names} vs {other}"]
    out = []
    if len(left) != len(right):
        out.append(f"rows {len(left)} vs {len(right)}")
    lset, rset = set(left), set(right)
    out += [f"spark only {r}" for r in [x for x in left if x not in rset][:3]]
    out += [f"oracle only {r}" for r in [x for x in right if x not in lset][:3]]
    if not out:
        for name, a, b in zip(names, zip(*left) if left else [], zip(*right) if right else []):
            ta, tb = ({type(v) for v in c if v is not None} for c in (a, b))
            if ta != tb:
                out.append(f"type of {name}: {ta} vs {tb}")
    return out


def main() -> int:
    import __spark_entry__ as entry
    from epitide.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = differences(df, con, oracles[name])
                kind = "ok" if not diff else "DIFF"
            else:
                n = len(df.collect())
                diff, kind = [], f"rows-only ({n})"
        except Exception as exc:  # report and go on with the next query
            diff, kind = [str(exc)[:1500]], "FAIL"
        bad += bool(diff)
        print(f"{name}: {kind} {time.time() - t0:.1f}s", flush=True)
        for line in diff:
            print("    ", line[:1200], flush=True)
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
