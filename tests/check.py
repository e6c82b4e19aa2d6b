"""Run registered queries next to their SQL and compare row by row: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(number of rows, differences or '')"""
    df = fn(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names2, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != names2:
        return len(got), f"columns {names} vs {names2}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return len(got), f"{names}: {len(got)} vs {len(want)} rows; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
    return len(got), ""


def main() -> None:
    import __spark_entry__ as entry
    from tesserix.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                n, diff = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                n, diff = len(fn(spark, sf_dir).collect()), ""
        except Exception as e:  # report and go on with the next query
            n, diff = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '}{name:32s} rows={n} {time.time() - start:.1f}s {diff[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
