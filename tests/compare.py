"""A query's rows against its SQL on DuckDB, in any order."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return str(v)


def connection(sf=SMALL):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def same(df, sql, con):
    rows = [r.asDict() for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    a = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in rows)
    at = sorted(range(len(names)), key=lambda i: names[i])
    b = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
