"""Run catalog queries in Spark and their SQL in DuckDB and compare all values.

    python -m tests.compare [name prefix ...]      SF_DIR=/root/testdata/sf0.01
"""
from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _key(row):
    return tuple((v is not None, str(type(v)) if not isinstance(v, (int, float)) else "n", v if v is not None else 0)
                 for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [str(x) for x in r])


def compare(spark_names, spark_rows, sql_names, sql_rows) -> str | None:
    """None when equal, else a short description of the first difference."""
    n1, r1 = rows_of(spark_names, spark_rows)
    n2, r2 = rows_of(sql_names, sql_rows)
    if n1 != n2:
        return f"columns {n1} != {n2}"
    if len(r1) != len(r2):
        extra = [r for r in r1 if r not in r2][:2] if len(r1) < 5000 else ""
        return f"rows {len(r1)} != {len(r2)}; e.g. spark {r1[:2]} duck {r2[:2]} extra {extra}"
    for a, b in zip(r1, r2):
        if repr(a) != repr(b):  # also tells -0.0 from 0.0
            bad = [(n, x, y) for n, x, y in zip(n1, a, b) if repr(x) != repr(y)]
            return f"first difference {bad} in {a} | {b}"
    return None


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as catalog
    from tablescope.session import build_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                         "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                         "spark.sql.session.timeZone": os.environ.get("SESSION_TZ", "UTC")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = catalog.oracle_sql()
    failed = 0
    for name, fn in catalog.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in sqls:
                cur = con.execute(sqls[name])
                problem = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
            else:
                problem = None
            tag = "ok  " if not problem else "FAIL"
            kind = "sql " if name in sqls else "rows"
            print(f"{tag} {kind} {name:42s} {len(rows):7d} rows {took:6.2f}s {problem or ''}"[:1500], flush=True)
            if problem or not rows:
                failed += bool(problem)
                if not rows:
                    print(f"     EMPTY {name}")
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL      {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    spark.stop()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
