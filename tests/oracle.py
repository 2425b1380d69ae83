"""Runs named queries against DuckDB on the same parquet files.

Command line: python tests/oracle.py [name-prefix ...]
SF_DIR picks the tables; BROADCAST=-1 turns size-based broadcasts off, as if
every table were large.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        return value
    return str(value)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(map(repr, r)))


def compare(df, con, sql):
    """None if equal, otherwise a short account of the difference."""
    got_names, got = as_rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = as_rows([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {sorted(set(got_names) ^ set(want_names))}", len(got)
    kinds = [{type(v) for r in got for v in (r[i],)} ^ {type(v) for r in want for v in (r[i],)}
             for i in range(len(got_names))]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(bad)} rows differ, first {str(diff)[:600]} (types {kinds})", len(got)
    return None, len(got)


def session(cpus: str = "8"):
    from larkspur.session import build_session
    return build_session("larkspur-check", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BROADCAST", "10MB")})


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem, n = compare(df, con, sqls[name])
            else:
                problem, n = None, len(df.collect())
            state = ("OK  " if name in sqls else "rows") if problem is None else "DIFF"
        except Exception as e:  # report and go on
            problem, n, state = str(e)[:1500], -1, "FAIL"
        bad += problem is not None
        print(f"{state} {name:36s} {n:7d} rows {time.time() - t0:6.2f}s {problem or ''}", flush=True)
    print("problems:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
