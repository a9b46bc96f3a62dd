"""Run every registered query and its SQL side by side and compare names, rows and values."""

import datetime as dt
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def difference(spark, con, folder, fn, sql):
    """None when equal, else a short description."""
    df = fn(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        return f"rows {len(got)} != {len(want)} extra={extra}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference {a} != {b}"
    if not got:
        return "both empty"
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    want_types = {d[0]: str(d[1]) for d in cur.description}
    return None if types == want_types else f"types {types} != {want_types}"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from opslake.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        at = time.time()
        try:
            diff = difference(spark, con, folder, fn, e.oracle_sql().get(name))
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        tag = "ok  " if diff is None else "FAIL"
        note = "" if name in e.oracle_sql() else " (rows only)"
        print(f"{tag} {name}{note} {time.time() - at:.2f}s {diff or ''}", flush=True)
    print("failures:", bad)
