"""Compare registered queries with their SQL counterparts in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if hasattr(value, "item"):
        return _norm(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def _key(row):
    return tuple("~" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark, con, name, fn, sql, folder) -> tuple[bool, str, int]:
    df = fn(spark, folder)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", len(got)
    exact = got == want
    if exact:
        return True, "", len(got)
    got.sort(key=_key)
    want.sort(key=_key)
    for a, b in zip(got, want):
        if a != b:
            return False, f"spark {a} != sql {b}"[:900], len(got)
    return True, "", len(got)


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from gradeline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                ok, why, n = compare(spark, con, name, queries[name], oracles[name], folder)
            else:
                n = queries[name](spark, folder).count()
                ok, why = True, "rows only"
        except Exception as exc:  # report every query, then fail at the end
            ok, why, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:<8d} {time.time() - start:6.2f}s {why}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
