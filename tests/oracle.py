"""Compare queries with their SQL twins in DuckDB."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), plain(x)) for k, x in v.items())
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def differences(spark, con, f, sql, folder):
    df = f(spark, folder)
    columns = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())
    here, there = set(got), set(want)
    return [x for x in got if x not in there][:3], [x for x in want if x not in here][:3], len(got) - len(want)
