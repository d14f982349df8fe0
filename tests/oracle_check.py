"""Run registered queries next to their SQL and report differences.

python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    key = lambda r: tuple((v is None, f"{v:.4e}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r)
    return [cols[i] for i in order], sorted(out, key=key)


def differences(spark_df, con, sql):
    """(exact, close, text): whether the results agree bit for bit, and within 1e-9."""
    rel = con.execute(sql)
    d_cols, d_rows = table([c[0] for c in rel.description], rel.fetchall())
    s_cols, s_rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if d_cols != s_cols:
        return False, False, f"columns {s_cols} vs {d_cols}", len(s_rows)
    if len(d_rows) != len(s_rows):
        return False, False, f"rows {len(s_rows)} vs {len(d_rows)}", len(s_rows)
    if d_rows == s_rows and all(type(a) is type(b) or {type(a), type(b)} <= {int, float} for x, y in zip(s_rows, d_rows) for a, b in zip(x, y)):
        kinds = {c for x, y in zip(s_rows, d_rows) for c, a, b in zip(s_cols, x, y) if type(a) is not type(b)}
        return True, True, f"types differ in {sorted(kinds)}" if kinds else "", len(s_rows)
    bad = []
    for x, y in zip(s_rows, d_rows):
        for c, a, b in zip(s_cols, x, y):
            if a == b:
                continue
            num = isinstance(a, (int, float)) and isinstance(b, (int, float))
            if not num or not math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12):
                bad.append((c, a, b))
    n_exact = sum(1 for x, y in zip(s_rows, d_rows) if x != y)
    return False, not bad, f"{n_exact} rows differ; {len(bad)} far, e.g. {bad[:3]}", len(s_rows)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                exact, close, text, n = differences(df, con, oracles[name])
            else:
                exact, close, text, n = True, True, "rows only", len(df.collect())
            state = "ok" if exact else ("close" if close else "FAIL")
        except Exception as e:
            state, text, n = "ERROR", "".join(traceback.format_exception_only(e))[:700], -1
        if state != "ok" or (text and text != "rows only"):
            failed.append(name)
        print(f"{state:6s} {name:28s} {n:8d} rows {time.time() - start:6.2f}s {text}", flush=True)
    print("not exact:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
